"""Queries on labels, windows, screening, portfolios, performance and the risk overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank_sql
from tessera.operators import metrics, overlay, portfolio
from tessera.sources.tables import PANEL_SQL, panel, with_target
from tessera.streaming.feeds import written

FEATURES = ["f_qty", "f_disc", "f_tax", "f_count"]
SCORE = "round(0.01 * f_qty + 10 * f_disc - 5 * f_tax + f_count, 6)"


def base(spark, sf_dir) -> DataFrame:
    """The panel with targets, written once for queries that read it several times."""
    return written(with_target(panel(spark, sf_dir)))


def scored(spark, sf_dir, table: DataFrame | None = None) -> DataFrame:
    df = with_target(panel(spark, sf_dir)) if table is None else table
    return df.withColumn("score", F.round(0.01 * F.col("f_qty") + 10 * F.col("f_disc") - 5 * F.col("f_tax") + F.col("f_count"), 6)).withColumn("series", F.col("industry_l1"))


def holdings(spark, sf_dir, table: DataFrame | None = None) -> DataFrame:
    return portfolio.build_portfolio(scored(spark, sf_dir, base(spark, sf_dir) if table is None else table), group=("series", "month_idx"))


def held(spark, sf_dir, table: DataFrame | None = None) -> DataFrame:
    return holdings(spark, sf_dir, table).filter("is_holding")


def closes(spark, sf_dir, table: DataFrame | None = None) -> DataFrame:
    df = panel(spark, sf_dir) if table is None else table
    return df.groupBy("month_idx").agg(F.round(F.avg("close"), 6).alias("close"))


def monthly(spark, sf_dir) -> DataFrame:
    table = base(spark, sf_dir)
    h = written(held(spark, sf_dir, table))
    return metrics.monthly_returns(h, metrics.benchmark_returns(closes(spark, sf_dir, table)), portfolio.turnover(h))


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


S = f"WITH {PANEL_SQL}, s AS (SELECT *, {SCORE} AS score, industry_l1 AS series FROM panel)"
H = f"""{S}, h0 AS (SELECT *, count(*) OVER (PARTITION BY series, month_idx) AS n, row_number() OVER (PARTITION BY series, month_idx ORDER BY score DESC, entity) AS place FROM s),
h AS (SELECT * EXCLUDE (n), CASE WHEN place <= 5 THEN 'High' WHEN place <= 10 THEN 'Low' ELSE 'Reserve' END AS tier, CASE WHEN place <= 5 THEN 0.13::DOUBLE WHEN place <= 10 THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM h0 WHERE place <= 20 AND n >= 15),
hh AS (SELECT * FROM h WHERE weight > 0)"""
T = f"""{H}, mo AS (SELECT series, month_idx, lead(month_idx) OVER (PARTITION BY series ORDER BY month_idx) AS nx, min(month_idx) OVER (PARTITION BY series) AS f FROM (SELECT DISTINCT series, month_idx FROM hh)),
ch AS (SELECT coalesce(a.series, b.series) AS series, coalesce(a.month_idx, b.nx) AS month_idx, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM hh a FULL JOIN (SELECT hh.*, nx FROM hh JOIN mo USING (series, month_idx) WHERE nx IS NOT NULL) b ON a.series = b.series AND a.month_idx = b.nx AND a.entity = b.entity),
t AS (SELECT c.series, c.month_idx, CASE WHEN c.month_idx = any_value(f) THEN 0 ELSE sum(greatest(-d, 0)) END AS sell, CASE WHEN c.month_idx = any_value(f) THEN 0 ELSE sum(greatest(d, 0)) END AS buy FROM ch c JOIN mo ON c.series = mo.series AND c.month_idx = mo.month_idx GROUP BY 1, 2),
tc AS (SELECT *, sell * 0.0023 + buy * 0.0013 AS cost, (sell + buy) / 2 AS rate FROM t)"""
M = f"""{T}, bk AS (SELECT month_idx, round(avg(close), 6) AS close FROM panel GROUP BY 1), bm AS (SELECT month_idx, lead(close) OVER (ORDER BY month_idx) / close - 1 AS b FROM bk),
g AS (SELECT series, month_idx, sum(weight * target) AS portfolio_return FROM hh WHERE target IS NOT NULL GROUP BY 1, 2),
m AS (SELECT g.*, coalesce(b, 0) AS benchmark_return, coalesce(cost, 0) AS turnover_cost, portfolio_return - coalesce(b, 0) AS excess_return, portfolio_return - coalesce(cost, 0) AS net_return FROM g LEFT JOIN bm USING (month_idx) LEFT JOIN tc USING (series, month_idx)),
cv AS (SELECT *, product(1 + portfolio_return) OVER o AS cum, row_number() OVER o AS n FROM m WINDOW o AS (PARTITION BY series ORDER BY month_idx)),
cd AS (SELECT *, cum / max(cum) OVER (PARTITION BY series ORDER BY month_idx) - 1 AS drawdown FROM cv)"""
X = f"""{M}, e1 AS (SELECT *, portfolio_return AS r, benchmark_return AS bb, excess_return AS ex, quantile_cont(portfolio_return, 0.05) OVER (PARTITION BY series) AS v5,
 CASE WHEN count(*) OVER six = 6 THEN sum(excess_return) OVER six END AS ex6, avg(excess_return) OVER six AS m6, stddev_samp(excess_return) OVER six AS s6,
 CASE WHEN n % 12 = 0 THEN min(drawdown) OVER (PARTITION BY series, (n - 1) // 12) END AS ydd FROM cd WINDOW six AS (PARTITION BY series ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
e2 AS (SELECT *, CASE WHEN ex6 IS NOT NULL THEN CASE WHEN s6 > 1e-8 THEN m6 / s6 * sqrt(12) ELSE 0 END END AS ir6, avg(r) OVER (PARTITION BY series) AS mu FROM e1),
a AS (SELECT series, count(*) AS months, arg_max(cum, n) AS cum, product(1 + bb) AS cum_bm, product(1 + net_return) AS cum_net, min(drawdown) AS mdd, avg(abs(drawdown)) AS pain, sqrt(avg(drawdown * drawdown)) AS ulcer,
 avg(CAST(ex > 0 AS DOUBLE)) AS win, stddev_samp(r) * sqrt(12) AS vol, coalesce(stddev_samp(CASE WHEN r < 0.0025 THEN r END) * sqrt(12), 1e-6) AS dvol, coalesce(stddev_samp(CASE WHEN r >= 0.0025 THEN r END) * sqrt(12), 1e-6) AS uvol,
 avg(ex) AS mex, stddev_samp(ex) AS sex, avg(r) AS mr, stddev_samp(r) AS sr, any_value(v5) AS v5, avg(CASE WHEN r <= v5 THEN r END) AS cv5, quantile_cont(r, 0.95) AS p95,
 avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS sk, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 AS ku,
 sum(CASE WHEN r > 0.0025 THEN r - 0.0025 ELSE 0 END) AS gain, sum(CASE WHEN r <= 0.0025 THEN 0.0025 - r ELSE 0 END) AS loss,
 avg(CASE WHEN bb > 0 THEN r END) / avg(CASE WHEN bb > 0 THEN bb END) AS upc, avg(CASE WHEN bb < 0 THEN r END) / avg(CASE WHEN bb < 0 THEN bb END) AS dnc, avg(ydd) AS ydd, sqrt(sum(ydd * ydd)) AS ydd2,
 avg(CAST(ex6 > 0 AS DOUBLE)) AS w6, avg(ir6) AS i6, avg(turnover_cost) AS tcost, regr_slope(r - 0.0025, bb - 0.0025) AS beta, regr_intercept(r - 0.0025, bb - 0.0025) AS alpha, regr_syy(r - 0.0025, bb - 0.0025) AS syy, regr_sxy(r - 0.0025, bb - 0.0025) AS sxy FROM e2 GROUP BY 1),
b AS (SELECT *, pow(cum, 12.0 / months) - 1 AS cagr, pow(cum_bm, 12.0 / months) - 1 AS cb, sqrt((syy - beta * sxy) / (months - 1)) AS res FROM a),
x AS (SELECT series, months, cagr, cb AS cagr_benchmark, cagr - cb AS annual_excess, pow(cum_net, 12.0 / months) - 1 AS net_cagr_after_cost, mdd AS max_drawdown, pain AS pain_index, ulcer AS ulcer_index, win AS monthly_win_rate, vol AS volatility, dvol AS downside_volatility, uvol AS upside_volatility,
 CASE WHEN dvol > 1e-8 THEN uvol / dvol ELSE 0 END AS volatility_ratio, CASE WHEN vol > 1e-8 THEN (cagr - 0.03) / vol ELSE 0 END AS sharpe, CASE WHEN dvol > 1e-8 THEN (cagr - 0.03) / dvol ELSE 0 END AS sortino, CASE WHEN abs(mdd) > 1e-8 THEN cagr / abs(mdd) ELSE 0 END AS calmar,
 CASE WHEN sex > 1e-8 THEN mex / sex * sqrt(12) ELSE 0 END AS ir, v5 AS var_95, cv5 AS cvar_95, sk AS skewness, ku AS kurtosis, CASE WHEN loss > 1e-8 THEN gain / loss ELSE 0 END AS omega, CASE WHEN abs(v5) > 1e-8 THEN p95 / abs(v5) ELSE 0 END AS tail,
 coalesce(upc, 0) AS up_capture, coalesce(dnc, 0) AS down_capture, CASE WHEN abs(coalesce(dnc, 0)) > 1e-8 THEN coalesce(upc, 0) / dnc ELSE 0 END AS capture, CASE WHEN abs(coalesce(ydd, mdd)) > 1e-8 THEN cagr / abs(coalesce(ydd, mdd)) ELSE 0 END AS sterling,
 CASE WHEN ydd2 > 0 THEN cagr / ydd2 ELSE 0 END AS burke, CASE WHEN ulcer > 1e-8 THEN cagr / ulcer ELSE 0 END AS martin, coalesce(w6, 0) AS rolling6m_win_rate, coalesce(i6, 0) AS rolling6m_ir,
 CASE WHEN months >= 12 THEN alpha * 12 ELSE 0 END AS jensen_alpha, CASE WHEN months >= 12 THEN beta ELSE 0 END AS beta, CASE WHEN months >= 12 AND res > 1e-8 THEN alpha / res ELSE 0 END AS appraisal,
 CASE WHEN sr > 1e-8 AND months > 1 THEN mr / sr * sqrt(months) ELSE 0 END AS sqn, tcost AS avg_monthly_turnover_cost, tcost * 12 AS avg_annual_turnover_cost FROM b)"""
_NAMES = "cagr cagr_benchmark annual_excess net_cagr_after_cost max_drawdown pain_index ulcer_index monthly_win_rate volatility downside_volatility upside_volatility volatility_ratio sharpe sortino calmar ir var_95 cvar_95 skewness kurtosis omega tail up_capture down_capture capture sterling burke martin rolling6m_win_rate rolling6m_ir jensen_alpha beta appraisal sqn avg_monthly_turnover_cost avg_annual_turnover_cost".split()


def _windows(spark, sf_dir):
    return portfolio.rolling_windows(panel(spark, sf_dir))


def _contributions(spark, sf_dir) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), (F.col(c) - 0.05).alias("value")) for c in FEATURES])
    return panel(spark, sf_dir).select("month_idx", F.explode(cells).alias("x")).select("month_idx", "x.*")


def _overlay_input(spark, sf_dir, table: DataFrame | None = None) -> DataFrame:
    """Entities are parts; two category votes and two oscillators from the panel's standardised factors. A month's means and deviations are a row that meets its rows."""
    df = (written(panel(spark, sf_dir).select("entity", "month_idx", *FEATURES)) if table is None else table).select("entity", "month_idx", *FEATURES)
    months = df.groupBy("month_idx").agg(*[x for c in FEATURES for x in (F.avg(c).alias(f"_m{c}"), F.stddev_pop(c).alias(f"_s{c}"))])
    df = df.join(F.broadcast(written(months)), "month_idx")  # a row a month
    z = lambda c: (F.col(c) - F.col(f"_m{c}")) / (F.col(f"_s{c}") + 1e-6)
    df = df.withColumns({"zq": F.round(z("f_qty"), 6), "zd": F.round(z("f_disc"), 6), "zt": F.round(z("f_tax"), 6), "zc": F.round(z("f_count"), 6)})
    df = df.withColumn("zt", F.when(F.col("entity") % 5 != 0, F.col("zt")))
    ts = overlay.trend_score([[F.col("zq") > 0, F.col("zt") > 0], [F.col("zc") > F.col("zq")]])
    ei = overlay.emotion_index([("zd", 1), ("zt", -1)])
    return df.select("entity", F.col("month_idx").cast("int").alias("seq"), F.round(ts, 6).alias("ts"), F.round(ei, 9).alias("ei"), F.lit(0.01).alias("weight"))


O = f"""WITH RECURSIVE {PANEL_SQL}, z0 AS (SELECT entity, month_idx AS seq, round((f_qty - avg(f_qty) OVER w) / (stddev_pop(f_qty) OVER w + 1e-6), 6) AS zq, round((f_disc - avg(f_disc) OVER w) / (stddev_pop(f_disc) OVER w + 1e-6), 6) AS zd,
 CASE WHEN entity % 5 <> 0 THEN round((f_tax - avg(f_tax) OVER w) / (stddev_pop(f_tax) OVER w + 1e-6), 6) END AS zt, round((f_count - avg(f_count) OVER w) / (stddev_pop(f_count) OVER w + 1e-6), 6) AS zc FROM panel0 WINDOW w AS (PARTITION BY month_idx)),
hold AS (SELECT entity, CAST(seq AS INTEGER) AS seq, round((CASE WHEN zt IS NULL THEN CASE WHEN zq > 0 THEN 1.0 ELSE -1.0 END ELSE ((CASE WHEN zq > 0 THEN 1.0 ELSE -1.0 END) + (CASE WHEN zt > 0 THEN 1.0 ELSE -1.0 END)) / 2 END + CASE WHEN zc > zq THEN 1.0 ELSE -1.0 END) / 2, 6) AS ts,
 round(CASE WHEN zt IS NULL THEN greatest(least(zd, 3.0), -3.0) / 3 ELSE (greatest(least(zd, 3.0), -3.0) / 3 + greatest(least(-zt, 3.0), -3.0) / 3) / 2 END, 9) AS ei FROM z0),
ord AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS k FROM hold),
f AS (SELECT entity, seq, ts, ei, k, CASE WHEN ei >= 0 THEN 1 ELSE -1 END AS sg, CAST(ts AS DOUBLE) AS ats, ts - ei < -1.0 AS sold, CASE WHEN ts - ei < -1.0 THEN 'SELL' ELSE 'HOLD' END AS label FROM ord WHERE k = 1
 UNION ALL SELECT entity, seq, ts, ei, k, sg2, ats2, ats2 - ei < -1.0, CASE WHEN ats2 - ei < -1.0 THEN 'SELL' WHEN kept AND psold THEN 'REENTER' ELSE 'HOLD' END FROM (
  SELECT *, CASE WHEN nw THEN CASE WHEN ei >= 0 THEN 1 ELSE -1 END WHEN cr THEN -psg ELSE psg END AS sg2, CASE WHEN nw OR cr THEN CAST(ts AS DOUBLE) ELSE pats END AS ats2 FROM (
   SELECT o.*, p.sg AS psg, p.ats AS pats, p.sold AS psold, p.seq = o.seq - 1 AS kept, p.seq <> o.seq - 1 OR p.sold AS nw, CASE WHEN p.sg > 0 THEN o.ei < -0.05 ELSE o.ei > 0.05 END AS cr FROM f p JOIN ord o ON o.entity = p.entity AND o.k = p.k + 1)))"""

QUERIES = {
    "forward_return": lambda s, d: with_target(panel(s, d)).select("entity", "month_idx", F.round("target", 6).alias("target")),
    "label_rank": lambda s, d: rounded(portfolio.label_rank(with_target(panel(s, d))).select("entity", "month_idx", "label_rank"), 9),
    "coverage": lambda s, d: rounded(portfolio.coverage(with_target(panel(s, d)), ["target", *FEATURES]), 9),
    "rolling_windows": lambda s, d: _windows(s, d),
    "window_stats": lambda s, d: portfolio.window_stats(panel(s, d), _windows(s, d)),
    "screen_features": lambda s, d: rounded(portfolio.screen(with_target(panel(s, d)), FEATURES), 8),
    "screen_correlation": lambda s, d: rounded(portfolio.correlations(panel(s, d), FEATURES), 8),
    "blend_scores": lambda s, d: rounded(portfolio.blend(panel(s, d).select("entity", "month_idx", (F.col("f_disc") * 10).alias("score_a"), (F.col("f_tax") * 10).alias("score_b")), 0.6).select("entity", "month_idx", "score", "score_cv")),
    "build_portfolio": lambda s, d: holdings(s, d).select("series", "pred_month", "entity", "score", "place", "tier", "weight"),
    "turnover_cost": lambda s, d: rounded(portfolio.turnover(written(held(s, d))), 8),
    "val_portfolio": lambda s, d: rounded(portfolio.validation_returns(scored(s, d)), 8),
    "stitch_validation": lambda s, d: rounded(portfolio.stitch(_windows(s, d).filter("split = 'valid'").join(portfolio.validation_returns(scored(s, d)), "month_idx").select("window_id", "month_idx", (F.col("ret") + F.col("window_id") / 1000).alias("ret"))), 8),
    "contrib_summary": lambda s, d: rounded(portfolio.contribution_summary(_contributions(s, d))),
    "contrib_by_month": lambda s, d: rounded(portfolio.contribution_by_month(_contributions(s, d), 3)),
    "contrib_correlation": lambda s, d: rounded(portfolio.contribution_correlation(_contributions(s, d))),
    "monthly_returns": lambda s, d: rounded(monthly(s, d), 8),
    "drawdown_curves": lambda s, d: rounded(metrics.curves(monthly(s, d)).select("series", "month_idx", "cum", "drawdown"), 7),
    "metrics": lambda s, d: rounded(metrics.measures(monthly(s, d)), 5),
    "check_thresholds": lambda s, d: metrics.check_thresholds(metrics.measures(monthly(s, d))),
    "lag_correlation": lambda s, d: rounded(metrics.lag_correlation(monthly(s, d)), 7),
    "tier_returns": lambda s, d: rounded(metrics.tier_returns(holdings(s, d)), 11),
    "risk_overlay": lambda s, d: rounded(overlay.run(_overlay_input(s, d)).select("entity", "seq", "ts", "ei", "sign", "ats", "timing", "sold", "label"), 9),
    "cash_pool": lambda s, d: rounded(overlay.cash_pool(overlay.run(_overlay_input(s, d))).select("seq", "cash_weight", "rf"), 8),
}
_W = f"""WITH {PANEL_SQL}, ms AS (SELECT month_idx, row_number() OVER (ORDER BY month_idx) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT month_idx FROM panel0)),
win AS (SELECT w AS window_id, month_idx, CASE WHEN pos - w < 36 THEN 'train' WHEN pos - w < 48 THEN 'valid' ELSE 'test' END AS split FROM ms, generate_series(0, (SELECT max(n) FROM ms) - 49) t(w) WHERE pos - w BETWEEN 0 AND 48)"""
_VAL = f"sv AS (SELECT *, {SCORE} AS score FROM panel), vp AS (SELECT month_idx, avg(greatest(least(coalesce(target, 0), 0.3), -0.3)) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY month_idx ORDER BY score DESC, entity) AS p FROM sv) WHERE p <= 10 GROUP BY 1)"
_FEATS = lambda f: " UNION ALL ".join(f(c) for c in FEATURES)
SQL = {
    "forward_return": f"WITH {PANEL_SQL} SELECT entity, month_idx, round(target, 6) AS target FROM panel",
    "label_rank": f"WITH {PANEL_SQL} SELECT entity, month_idx, round(({avg_rank_sql('target', 'month_idx')}) / count(target) OVER (PARTITION BY month_idx), 9) AS label_rank FROM panel",
    "coverage": f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CAST({c} IS NOT NULL AS DOUBLE)), 9) AS coverage FROM panel" for c in ("target", *FEATURES)),
    "rolling_windows": f"{_W} SELECT * FROM win",
    "window_stats": f"{_W} SELECT window_id, split, CAST(sum(c) AS BIGINT) AS rows, count(*) AS months, min(month_idx) AS first, max(month_idx) AS last FROM win JOIN (SELECT month_idx, count(*) AS c FROM panel0 GROUP BY 1) USING (month_idx) GROUP BY 1, 2",
    "screen_features": f"WITH {PANEL_SQL} " + _FEATS(lambda c: f"SELECT '{c}' AS feature, round(avg(CAST({c} IS NOT NULL AS DOUBLE)), 8) AS coverage, round(stddev_samp({c}), 8) AS std, round(abs(corr({c}, target)), 8) AS ic FROM panel WHERE target IS NOT NULL"),
    "screen_correlation": f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM panel0" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]),
    "blend_scores": f"WITH {PANEL_SQL}, q AS (SELECT entity, month_idx, f_disc * 10 AS a, f_tax * 10 AS b, 0.6 * (f_disc * 10) + 0.4 * (f_tax * 10) AS score FROM panel0) SELECT entity, month_idx, round(score, 6) AS score, round(abs(a - b) / 2 / (abs(score) + 1e-6), 6) AS score_cv FROM q",
    "build_portfolio": f"{H} SELECT series, pred_month, entity, score, place, tier, weight FROM h",
    "turnover_cost": f"{T} SELECT series, month_idx, round(sell, 8) AS sell, round(buy, 8) AS buy, round(cost, 8) AS cost, round(rate, 8) AS rate FROM tc",
    "val_portfolio": f"WITH {PANEL_SQL}, {_VAL} SELECT month_idx, round(ret, 8) AS ret FROM vp",
    "stitch_validation": f"{_W}, {_VAL} SELECT month_idx, max(window_id) AS window_id, round(arg_max(ret + window_id / 1000, window_id), 8) AS ret FROM win JOIN vp USING (month_idx) WHERE split = 'valid' GROUP BY 1",
    "contrib_by_month": f"WITH {PANEL_SQL}, u AS ({_FEATS(lambda c: f'''SELECT month_idx, '{c}' AS factor, {c} - 0.05 AS value FROM panel0''')}), k AS (SELECT factor, month_idx, avg(abs(value)) AS a, avg(value) AS v FROM u GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY month_idx ORDER BY a DESC, factor) AS place FROM k) SELECT month_idx, factor, round(a, 6) AS mean_abs, round(v, 6) AS mean_signed, place FROM p WHERE place <= 3",
    "contrib_correlation": f"WITH {PANEL_SQL}, u AS ({_FEATS(lambda c: f'''SELECT month_idx, '{c}' AS factor, {c} - 0.05 AS value FROM panel0''')}), k AS (SELECT factor, month_idx, avg(value) AS v FROM u GROUP BY 1, 2) SELECT a.factor, b.factor AS other, round(corr(a.v, b.v), 6) AS corr FROM k a JOIN k b USING (month_idx) GROUP BY 1, 2",
    "contrib_summary": f"WITH {PANEL_SQL}, u AS ({_FEATS(lambda c: f'''SELECT month_idx, '{c}' AS factor, {c} - 0.05 AS value FROM panel0''')}), k AS (SELECT factor, month_idx, avg(abs(value)) AS a, avg(value) AS v FROM u GROUP BY 1, 2), g AS (SELECT factor, avg(a) AS mean_abs, avg(v) AS mean_signed, count(*) AS months FROM k GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY mean_abs DESC, factor) AS place FROM g) SELECT factor, round(mean_abs, 6) AS mean_abs, round(mean_signed, 6) AS mean_signed, months, place FROM p WHERE place <= 5",
    "monthly_returns": f"{M} SELECT series, month_idx, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("portfolio_return", "benchmark_return", "turnover_cost", "excess_return", "net_return")) + " FROM m",
    "drawdown_curves": f"{M} SELECT series, month_idx, round(cum, 7) AS cum, round(drawdown, 7) AS drawdown FROM cd",
    "metrics": f"{X} SELECT series, months, " + ", ".join(f"round({c}, 5) AS {c}" for c in _NAMES) + " FROM x",
    "check_thresholds": f"{X} SELECT *, " + " AND ".join([f"pass_{m}" for m, _ in metrics.THRESHOLDS] + ["pass_pain_index"]) + " AS pass_all FROM (SELECT series, " + ", ".join(f"{m} >= {v} AS pass_{m}" for m, v in metrics.THRESHOLDS) + ", pain_index <= 0.10 AS pass_pain_index FROM x)",
    "lag_correlation": f"{M} SELECT a.series, CAST(l AS INTEGER) AS lag, count(*) AS pairs, round(CASE WHEN count(*) >= 5 THEN corr(a.portfolio_return, b.benchmark_return) END, 7) AS r FROM m a, generate_series(-3, 3) t(l), m b WHERE a.series = b.series AND b.month_idx = a.month_idx + l GROUP BY 1, 2",
    "tier_returns": f"{H} SELECT series, tier, month_idx, round(sum(weight * target) / sum(weight), 11) AS ret FROM hh WHERE target IS NOT NULL GROUP BY 1, 2, 3",
    "risk_overlay": f"{O} SELECT entity, seq, CAST(ts AS DOUBLE) AS ts, ei, CAST(sg AS INTEGER) AS sign, round(ats, 9) AS ats, round(ats - ei, 9) AS timing, sold, label FROM f",
    "cash_pool": f"{O} SELECT seq, round(count(*) * 0.01::DOUBLE, 8) AS cash_weight, round(0.025 / 12, 8) AS rf FROM f WHERE sold GROUP BY 1",
}
