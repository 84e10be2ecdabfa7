"""Queries on the validation portfolio, its measures, and the rows that complete other reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank_sql
from tessera.operators import attribution, cross, metrics, portfolio, selection, sketches, validation
from tessera.sources import ingest
from tessera.sources.tables import PANEL_SQL, panel, with_target
from tessera.streaming.feeds import written

from .reports import _candidates
from .strategy import _W, FEATURES, H, M, S, base, closes, held, holdings, monthly, rounded, scored


def _months(s, d) -> DataFrame:
    return validation.portfolio_months(scored(s, d))


def _measures(s, d) -> DataFrame:
    table = base(s, d)
    judged = portfolio.label_rank(scored(s, d, table).select("series", "month_idx", "entity", "score", "target"))
    months = validation.portfolio_months(judged).join(metrics.benchmark_returns(closes(s, d, table)).fillna(0.0, ["benchmark_return"]), "month_idx")
    return validation.measures(written(months), validation.score_ics(judged))


def _adjusted(s, d) -> DataFrame:
    df = panel(s, d).select("entity", "month_idx", "close")
    known = df.filter("month_idx % 6 > 1 and entity % 4 > 0").select("entity", "month_idx", (1 + F.col("month_idx") % 10 / 100).alias("adj"))
    return validation.adjusted_return(df, known)


def _suspended(s, d) -> DataFrame:
    rules = ingest.universe_rules(252, (0.01, 0.15), (1500.0, 40000.0), 1000.0, most_suspended=5)
    return ingest.reject_counts(_candidates(s, d).withColumn("suspend_days", F.when(F.col("entity") % 19 > 0, F.col("entity") % 9)), rules)


def _evenly(s, d) -> DataFrame:
    """Brinson effects where every other month of the universe is missing."""
    effects = attribution.brinson(holdings(s, d).filter("is_holding"), with_target(panel(s, d)).filter("month_idx % 2 = 0"))
    return effects.select("series", "month_idx", "industry", "w_port", "w_benchmark", "allocation", "selection", "interaction")


def _misvalued(s, d) -> DataFrame:
    df = panel(s, d).select("entity", "month_idx", (F.col("close") / 100).alias("pb"), cross.earnings_on_book(F.col("f_qty") / 2, F.col("f_disc") * 100).alias("x"))
    return cross.misvaluation(df)


def _named(s, d) -> DataFrame:
    df = panel(s, d)
    places = {f"top{i}_{k}": c for i, f in enumerate(FEATURES[:3], 1) for k, c in (("factor", F.when(F.col("entity") % (i + 2) > 0, F.lit(f))), ("value", F.col(f) - 0.05))}
    return portfolio.contribution_summary(validation.top_contributions(df.select("month_idx", *[c.alias(k) for k, c in places.items()]), None))


def _given(s, d) -> DataFrame:
    h = held(s, d).withColumn("contribution", F.when(F.col("entity") % 3 == 0, F.col("score") / 1000)).select("series", "month_idx", "entity", "weight", "target", "contribution")
    none = s.createDataFrame([], "entity bigint, seq bigint, label string, timing double")
    return selection.holdings_view(h, none).select("series", "month_idx", "entity", F.round("contribution", 10).alias("contribution"), "action")


def _sketched(s, d) -> DataFrame:
    """Windows from the months' stored states, and whether they agree with the rows themselves."""
    df, columns = written(panel(s, d).select("entity", "month_idx", "close", "f_qty")), ["close", "f_qty"]
    windows = written(portfolio.rolling_windows(df))
    found = written(sketches.estimates(sketches.merged(written(sketches.month_states(df, columns)), windows, columns), columns))
    return sketches.within_bounds(df, windows, found, columns)


QUERIES = {
    "sketched_windows": _sketched,
    "validation_months": lambda s, d: rounded(_months(s, d), 8),
    "validation_measures": lambda s, d: rounded(_measures(s, d), 5),
    "best_lag": lambda s, d: rounded(validation.best_lag(metrics.lag_correlation(monthly(s, d)).withColumn("r", F.round("r", 9))), 7),
    "tier_curves": lambda s, d: rounded(validation.tier_curves(metrics.tier_returns(holdings(s, d))), 11),
    "adjusted_return": lambda s, d: rounded(_adjusted(s, d), 8),
    "universe_suspended": _suspended,
    "brinson_even_benchmark": lambda s, d: rounded(_evenly(s, d), 9),
    "misvaluation_earnings": lambda s, d: rounded(_misvalued(s, d).select("entity", "month_idx", "misvaluation")),
    "contrib_named_places": lambda s, d: rounded(_named(s, d)),
    "holdings_given_contribution": _given,
}
_NET = """vh AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY series, month_idx ORDER BY score DESC, entity) AS vp FROM s) WHERE vp <= 10), vw AS (SELECT *, CASE WHEN vp <= 5 THEN 0.13::DOUBLE ELSE 0.07::DOUBLE END AS weight FROM vh),
vg AS (SELECT series, month_idx, sum(weight * greatest(least(coalesce(target, 0), 0.3), -0.3)) AS gross FROM vw GROUP BY 1, 2),
vm AS (SELECT series, month_idx, lead(month_idx) OVER (PARTITION BY series ORDER BY month_idx) AS nx, min(month_idx) OVER (PARTITION BY series) AS f FROM vg),
vc AS (SELECT coalesce(a.series, b.series) AS series, coalesce(a.month_idx, b.nx) AS month_idx, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM vw a FULL JOIN (SELECT vw.series, vw.entity, vw.weight, nx FROM vw JOIN vm USING (series, month_idx) WHERE nx IS NOT NULL) b ON a.series = b.series AND a.month_idx = b.nx AND a.entity = b.entity),
vt AS (SELECT c.series, c.month_idx, CASE WHEN c.month_idx = any_value(f) THEN 0 ELSE sum(greatest(-d, 0)) * 0.0023 + sum(greatest(d, 0)) * 0.0013 END AS cost, CASE WHEN c.month_idx = any_value(f) THEN 0 ELSE sum(abs(d)) / 2 END AS rate FROM vc c JOIN vm ON c.series = vm.series AND c.month_idx = vm.month_idx GROUP BY 1, 2),
vn AS (SELECT series, month_idx, gross, cost, rate, gross - cost AS net_return FROM vg JOIN vt USING (series, month_idx))"""
_OUT = "val_rolling6m_ir val_rolling6m_dir val_rolling6m_sortino val_rolling6m_return val_rolling6m_excess val_ir_stability val_ic_stability pct_positive_excess turnover_penalty val_var_95 val_cvar_95 val_pain_index val_rolling6m_excess_ann val_global_ir val_annual_return ir_worst_quartile up_capture_ratio down_capture_ratio capture_ratio val_jensen_alpha val_beta val_appraisal_ratio val_sqn".split()
_RULES = {"suspended": "suspend_days <= 5", "name": "coalesce(NOT regexp_matches(name, 'ST|PT'), true)", "days_listed": "days_listed >= 252", "turnover": "turnover BETWEEN 0.01 AND 0.15", "market_cap": "market_cap BETWEEN 1500 AND 40000", "price": "close >= 1000"}
SQL = {
    "sketched_windows": f"{_W} SELECT window_id, split, count(*) AS rows, true AS keys_ok, true AS quantiles_ok FROM panel0 JOIN win USING (month_idx) GROUP BY 1, 2",
    "validation_months": f"{S}, {_NET} SELECT series, month_idx, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("gross", "cost", "rate", "net_return")) + " FROM vn",
    "validation_measures": f"""{S}, {_NET}, bk AS (SELECT month_idx, round(avg(close), 6) AS close FROM panel GROUP BY 1), bm AS (SELECT month_idx, coalesce(lead(close) OVER (ORDER BY month_idx) / close - 1, 0) AS b FROM bk),
lr AS (SELECT *, {avg_rank_sql("target", "month_idx")} AS lb FROM s), lc AS (SELECT * FROM lr WHERE lb IS NOT NULL), lk AS (SELECT *, {avg_rank_sql("score", "series", "month_idx")} AS ra, {avg_rank_sql("lb", "series", "month_idx")} AS rb FROM lc),
ic AS (SELECT series, month_idx, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) ELSE 0 END AS ic FROM lk GROUP BY 1, 2 HAVING count(*) >= 10),
i6 AS (SELECT series, CASE WHEN count(*) OVER w = 6 THEN avg(ic) OVER w END AS ic6 FROM ic WINDOW w AS (PARTITION BY series ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), ix AS (SELECT series, stddev_samp(ic6) AS ics FROM i6 GROUP BY 1),
a AS (SELECT vn.*, net_return AS r, b, net_return - b AS ex FROM vn JOIN bm USING (month_idx)),
w AS (SELECT *, count(*) OVER six = 6 AS fl, avg(ex) OVER six AS m6, stddev_samp(ex) OVER six AS s6, avg(r) OVER six AS n6, stddev_samp(r) OVER six AS t6, count(CASE WHEN ex < 0 THEN 1 END) OVER six AS cl, stddev_samp(CASE WHEN ex < 0 THEN ex END) OVER six AS sl, count(CASE WHEN r < 0.0025 THEN 1 END) OVER six AS cd, stddev_samp(CASE WHEN r < 0.0025 THEN r END) OVER six AS sd,
 product(1 + r) OVER six - 1 AS p6, product(1 + r) OVER (PARTITION BY series ORDER BY month_idx) AS cum, quantile_cont(r, 0.05) OVER (PARTITION BY series) AS v5, row_number() OVER (PARTITION BY series ORDER BY ex, month_idx) AS pl, count(*) OVER (PARTITION BY series) AS n FROM a WINDOW six AS (PARTITION BY series ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, CASE WHEN fl THEN CASE WHEN s6 > 1e-8 THEN m6 / s6 * sqrt(12) ELSE 0 END END AS ir6, CASE WHEN fl THEN m6 / greatest(CASE WHEN cl > 1 THEN sl ELSE s6 END, 1e-8) * sqrt(12) END AS d6, CASE WHEN fl THEN (n6 - 0.0025) / greatest(CASE WHEN cd > 1 THEN sd ELSE t6 END, 1e-6) * sqrt(12) END AS o6, cum / max(cum) OVER (PARTITION BY series ORDER BY month_idx) - 1 AS dd, CASE WHEN pl <= greatest(1, n // 4) THEN ex END AS wx FROM w),
g AS (SELECT series, count(*) AS months, avg(ir6) AS val_rolling6m_ir, avg(d6) AS val_rolling6m_dir, avg(o6) AS val_rolling6m_sortino, avg(p6) FILTER (fl) AS val_rolling6m_return, avg(m6) FILTER (fl) AS val_rolling6m_excess, stddev_samp(ir6) AS val_ir_stability, avg(CAST(ex > 0 AS DOUBLE)) AS pct_positive_excess, avg(rate) AS turnover_penalty, any_value(v5) AS val_var_95, avg(r) FILTER (r <= v5) AS val_cvar_95, avg(abs(dd)) AS val_pain_index,
 12 * avg(m6) FILTER (fl) AS val_rolling6m_excess_ann, CASE WHEN stddev_samp(ex) > 1e-8 THEN avg(ex) / stddev_samp(ex) * sqrt(12) END AS val_global_ir, pow(product(1 + r), 12.0 / count(*)) - 1 AS val_annual_return, greatest(least(avg(wx) / greatest(coalesce(stddev_samp(wx), 1e-8), 1e-8), 5.0), -5.0) AS ir_worst_quartile,
 count(*) >= 12 AND count(*) FILTER (b > 0) >= 3 AND count(*) FILTER (b < 0) >= 3 AS cap, avg(r) FILTER (b > 0) / avg(b) FILTER (b > 0) AS u, avg(r) FILTER (b < 0) / avg(b) FILTER (b < 0) AS dn, regr_slope(r - 0.0025, b - 0.0025) AS be, regr_intercept(r - 0.0025, b - 0.0025) AS al, regr_syy(r - 0.0025, b - 0.0025) AS syy, regr_sxy(r - 0.0025, b - 0.0025) AS sxy, CASE WHEN stddev_samp(r) > 1e-8 THEN avg(r) / stddev_samp(r) * sqrt(count(*)) END AS val_sqn FROM w2 GROUP BY 1),
x AS (SELECT g.*, ics AS val_ic_stability, CASE WHEN cap THEN round(u, 4) END AS up_capture_ratio, CASE WHEN cap THEN round(dn, 4) END AS down_capture_ratio, CASE WHEN cap AND abs(dn) >= 1e-6 THEN round(u / dn, 4) END AS capture_ratio, CASE WHEN months >= 12 THEN al * 12 END AS val_jensen_alpha, CASE WHEN months >= 12 THEN be END AS val_beta, CASE WHEN months >= 12 AND sqrt(greatest(syy - be * sxy, 0) / (months - 1)) > 1e-8 THEN al / sqrt(greatest(syy - be * sxy, 0) / (months - 1)) END AS val_appraisal_ratio FROM g LEFT JOIN ix USING (series))
SELECT series, months, """ + ", ".join(f"CASE WHEN months >= 6 THEN round(coalesce({c}, 0), 5) ELSE 0 END AS {c}" for c in _OUT) + " FROM x",
    "best_lag": f"{M}, l AS (SELECT a.series, CAST(l AS INTEGER) AS lag, round(CASE WHEN count(*) >= 5 THEN corr(a.portfolio_return, b.benchmark_return) END, 9) AS r FROM m a, generate_series(-3, 3) t(l), m b WHERE a.series = b.series AND b.month_idx = a.month_idx + l GROUP BY 1, 2) SELECT series, first(lag ORDER BY abs(r) DESC, abs(lag), lag) AS best_lag, round(first(r ORDER BY abs(r) DESC, abs(lag), lag), 7) AS r FROM l WHERE r IS NOT NULL GROUP BY 1",
    "tier_curves": f"{H}, t1 AS (SELECT series, tier, month_idx, sum(weight * target) / sum(weight) AS ret FROM hh WHERE target IS NOT NULL GROUP BY 1, 2, 3), t2 AS (SELECT *, product(1 + ret) OVER (PARTITION BY series, tier ORDER BY month_idx) AS cum FROM t1) SELECT series, tier, month_idx, round(ret, 11) AS ret, round(cum, 11) AS cum, round(cum / max(cum) OVER (PARTITION BY series, tier ORDER BY month_idx) - 1, 11) AS drawdown FROM t2",
    "adjusted_return": f"WITH {PANEL_SQL}, p AS (SELECT entity, month_idx, close, CASE WHEN month_idx % 6 > 1 AND entity % 4 > 0 THEN 1 + month_idx % 10 / 100 END AS adj FROM panel0), j AS (SELECT a.*, b.close AS c2, b.adj AS a2 FROM p a LEFT JOIN p b ON a.entity = b.entity AND b.month_idx = a.month_idx + 1), k AS (SELECT *, bool_or(c2 IS NOT NULL AND adj IS NOT NULL AND a2 IS NOT NULL) OVER (PARTITION BY month_idx) AS sm FROM j) SELECT entity, month_idx, round(CASE WHEN c2 IS NULL OR sm AND (adj IS NULL OR a2 IS NULL) THEN NULL ELSE greatest(least(CASE WHEN sm THEN c2 * a2 / (close * adj) ELSE c2 / close END - 1, 0.5), -0.5) END, 8) AS target FROM k",
    "universe_suspended": f"WITH {PANEL_SQL}, cd AS (SELECT close, CASE WHEN entity % 13 = 0 THEN 'ST x' WHEN entity % 17 <> 0 THEN industry END AS name, entity % 900 AS days_listed, f_qty / 1000 AS turnover, market_cap, CASE WHEN entity % 19 > 0 THEN entity % 9 END AS suspend_days FROM panel0) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({v}, false)) AS rejected FROM cd" for k, v in _RULES.items()),
    "brinson_even_benchmark": f"""{H}, un AS (SELECT * FROM panel WHERE month_idx % 2 = 0), tgt AS (SELECT * FROM un WHERE target IS NOT NULL), uni AS (SELECT month_idx, industry, count(*) / sum(count(*)) OVER (PARTITION BY month_idx) AS wb FROM un GROUP BY 1, 2), ri AS (SELECT month_idx, industry, avg(target) AS rb FROM tgt GROUP BY 1, 2), rm AS (SELECT month_idx, avg(target) AS rm FROM tgt GROUP BY 1),
po AS (SELECT series, month_idx, industry, sum(weight) AS w_port, coalesce(sum(weight * target) / sum(weight), 0) AS r_port FROM hh GROUP BY 1, 2, 3), pe AS (SELECT *, 1 / count(*) OVER (PARTITION BY series, month_idx) AS ev FROM po),
q AS (SELECT series, month_idx, industry, w_port, r_port, coalesce(wb, CASE WHEN month_idx % 2 = 1 THEN ev ELSE 0 END) AS w_benchmark, coalesce(rb, 0) AS rb, coalesce(rm, 0) AS rm FROM pe LEFT JOIN uni USING (month_idx, industry) LEFT JOIN ri USING (month_idx, industry) LEFT JOIN rm USING (month_idx))
SELECT series, month_idx, industry, round(w_port, 9) AS w_port, round(w_benchmark, 9) AS w_benchmark, round((w_port - w_benchmark) * (rb - rm), 9) AS allocation, round(w_benchmark * (r_port - rb), 9) AS selection, round((w_port - w_benchmark) * (r_port - rb), 9) AS interaction FROM q""",
    "misvaluation_earnings": f"WITH {PANEL_SQL}, p AS (SELECT entity, month_idx, close / 100 AS pb, f_qty / 2 / 100 * (1 + f_disc * 100 / 100) AS x FROM panel0), g AS (SELECT month_idx, count(*) AS n, regr_sxx(pb, x) AS sxx, regr_slope(pb, x) AS g1, regr_intercept(pb, x) AS g0 FROM p WHERE pb > 0 AND abs(x) < 10 GROUP BY 1) SELECT entity, month_idx, round(CASE WHEN pb > 0 AND abs(x) < 10 AND n >= 30 AND sxx >= 1e-10 THEN greatest(least((g0 + g1 * x) / pb - 1, 5.0), -5.0) END, 6) AS misvaluation FROM p LEFT JOIN g USING (month_idx)",
    "contrib_named_places": f"WITH {PANEL_SQL}, u AS (" + " UNION ALL ".join(f"SELECT month_idx, '{f}' AS factor, {f} - 0.05 AS value FROM panel0 WHERE entity % {i + 2} > 0" for i, f in enumerate(FEATURES[:3], 1)) + "), k AS (SELECT factor, month_idx, avg(abs(value)) AS a, avg(value) AS v FROM u GROUP BY 1, 2), g AS (SELECT factor, avg(a) AS mean_abs, avg(v) AS mean_signed, count(*) AS months FROM k GROUP BY 1) SELECT factor, round(mean_abs, 6) AS mean_abs, round(mean_signed, 6) AS mean_signed, months, row_number() OVER (ORDER BY mean_abs DESC, factor) AS place FROM g",
    "holdings_given_contribution": f"{H} SELECT series, month_idx, entity, round(CASE WHEN entity % 3 = 0 THEN score / 1000 ELSE weight * target END, 10) AS contribution, 'HOLD' AS action FROM hh",
}
