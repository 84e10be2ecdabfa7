"""Queries on ingest, attribution and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import attribution, cross, trials
from tessera.sources import ingest
from tessera.sources.tables import BARS_SQL, PANEL_SQL, bars, panel, table, with_target

from .strategy import H, base, holdings, rounded


EFFECTS = ("w_port", "r_port", "w_benchmark", "r_benchmark", "r_market", "allocation", "selection", "interaction")


def _calendar(s, d):
    return table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))


def _candidates(s, d) -> DataFrame:
    return panel(s, d).select("entity", "month_idx", "close", F.when(F.col("entity") % 13 == 0, "ST x").when(F.col("entity") % 17 != 0, F.col("industry")).alias("name"), (F.col("entity") % 900).alias("days_listed"), (F.col("f_qty") / 1000).alias("turnover"), "market_cap")


def _rules():
    return ingest.universe_rules(252, (0.01, 0.15), (1500.0, 40000.0), 1000.0)


def _statements(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("announced"), F.col("o_totalprice").alias("value")).groupBy("entity", "announced").agg(F.max("value").alias("value"))


def _asof(s, d) -> DataFrame:
    ends = ingest.month_end_days(_calendar(s, d)).select(F.col("last_day").alias("date"))  # one row a month
    left = table(s, d, "customer").select(F.col("c_custkey").alias("entity")).join(F.broadcast(ends))
    return ingest.asof(left, _statements(s, d), "entity", "date", "announced")


def _adjusted(s, d) -> DataFrame:
    factors = bars(s, d).filter(F.dayofmonth("date") <= 10).select("entity", "date", (1 + F.dayofyear("date") / 1000).alias("adj"))
    return ingest.adjust_prices(bars(s, d), factors).select("entity", "date", "open", "high", "low", "close")


def ordered(s, d) -> DataFrame:
    """Parts and the months in which they were ordered, beside the panel's, in which they were shipped."""
    items = table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("entity"))
    days = table(s, d, "orders").select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_idx"))
    return items.join(days, F.col("l_orderkey") == F.col("o_orderkey")).select("entity", "month_idx").distinct()


ORDERED = "SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS month_idx, l_partkey AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _effects(s, d, table: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    table = base(s, d) if table is None else table
    return attribution.brinson(holdings(s, d, table).filter("is_holding") if of is None else of, table)


def _trials(s, d) -> DataFrame:
    """One trial a part; some failed, some without a value."""
    p, key = table(s, d, "part"), F.col("p_partkey")
    x = ((key * 37) % 101 - 50) / 100
    return p.select(
        key.alias("number"), F.when(key % 29 == 0, "FAIL").when(key % 31 == 0, "RUNNING").otherwise("COMPLETE").alias("state"),
        F.when(key % 23 == 0, float("nan")).when(key % 19 == 0, -999.0).otherwise(-F.col("p_retailprice")).alias("value"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type")).alias("params"),
        F.when(key % 41 != 0, F.create_map(F.lit("val_ic"), x / 5, F.lit("val_icir"), x * x - 0.1, F.lit("sharpe_ratio"), F.when(key % 7 == 0, float("nan")).otherwise(x * 3), F.lit("cagr"), F.lit(0.0))).otherwise(F.create_map().cast("map<string,double>")).alias("attrs"),
    )


def _weights(s):
    return s.createDataFrame([("val_ic", 2.0, 1), ("val_icir", 1.0, 1), ("sharpe_ratio", 0.5, -1), ("cagr", 1.0, 1)], "metric string, weight double, direction int")


def _normalized(s, d):
    t = _trials(s, d)
    return trials.normalize_adaptive(trials.attributes(trials.valid(t)), trials.metric_quantiles(t))


TR = """tr AS (SELECT p_partkey AS number, CASE WHEN p_partkey % 29 = 0 THEN 'FAIL' WHEN p_partkey % 31 = 0 THEN 'RUNNING' ELSE 'COMPLETE' END AS state,
 CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN -999.0 ELSE -p_retailprice END AS value, p_partkey % 23 = 0 AS isn, p_size, p_brand, p_type, p_partkey % 41 <> 0 AS has, ((p_partkey * 37) % 101 - 50) / 100 AS x FROM part),
va AS (SELECT * FROM tr WHERE state = 'COMPLETE' AND NOT isn AND value > -999),
lg AS (SELECT number, 'val_ic' AS metric, x / 5 AS v FROM va WHERE has UNION ALL SELECT number, 'val_icir', x * x - 0.1 FROM va WHERE has UNION ALL SELECT number, 'sharpe_ratio', CASE WHEN number % 7 <> 0 THEN x * 3 END FROM va WHERE has UNION ALL SELECT number, 'cagr', 0.0 FROM va WHERE has),
qt AS (SELECT metric, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, avg(CAST(v > 0 AS DOUBLE)) AS positive_rate, avg(CAST(v = 0 AS DOUBLE)) AS zero_rate, avg(CAST(v IS NULL AS DOUBLE)) AS missing_rate FROM lg GROUP BY 1),
nz AS (SELECT number, metric, CASE WHEN zero_rate > 0.9 OR missing_rate > 0.9 OR v IS NULL THEN 0 WHEN metric = 'val_ic' THEN (greatest(least(v, p95), p5) - p5) / (p95 - p5) - 0.5 ELSE tanh((v - p50) / greatest((p95 - p5) / 2, 1e-6)) END AS z FROM lg JOIN qt USING (metric))"""
PR = """pm AS (SELECT number, value, 'size' AS param, CAST(p_size AS VARCHAR) AS v FROM va UNION ALL SELECT number, value, 'brand', p_brand FROM va UNION ALL SELECT number, value, 'kind', p_type FROM va)"""
CAND = f"WITH {PANEL_SQL}, cd AS (SELECT entity, month_idx, close, CASE WHEN entity % 13 = 0 THEN 'ST x' WHEN entity % 17 <> 0 THEN industry END AS name, entity % 900 AS days_listed, f_qty / 1000 AS turnover, market_cap FROM panel0)"
_TESTS = {"name": "coalesce(NOT regexp_matches(name, 'ST|PT'), true)", "days_listed": "days_listed >= 252", "turnover": "turnover BETWEEN 0.01 AND 0.15", "market_cap": "market_cap BETWEEN 1500 AND 40000", "price": "close >= 1000"}
BR = f"""{H}, tgt AS (SELECT * FROM panel WHERE target IS NOT NULL), uni AS (SELECT month_idx, industry, count(*) / sum(count(*)) OVER (PARTITION BY month_idx) AS wb FROM panel GROUP BY 1, 2), ri AS (SELECT month_idx, industry, avg(target) AS rb FROM tgt GROUP BY 1, 2), rm AS (SELECT month_idx, avg(target) AS rm FROM tgt GROUP BY 1),
po AS (SELECT series, month_idx, industry, sum(weight) AS w_port, coalesce(sum(weight * target) / sum(weight), 0) AS r_port FROM hh GROUP BY 1, 2, 3),
br AS (SELECT series, month_idx, industry, w_port, r_port, coalesce(wb, 0) AS w_benchmark, coalesce(rb, 0) AS r_benchmark, coalesce(rm, 0) AS r_market, (w_port - coalesce(wb, 0)) * (coalesce(rb, 0) - coalesce(rm, 0)) AS allocation, coalesce(wb, 0) * (r_port - coalesce(rb, 0)) AS selection, (w_port - coalesce(wb, 0)) * (r_port - coalesce(rb, 0)) AS interaction
 FROM po LEFT JOIN uni USING (month_idx, industry) LEFT JOIN ri USING (month_idx, industry) LEFT JOIN rm USING (month_idx))"""
STYLES = ["f_disc", "f_qty"]
_PROXY = {"smb": ("market_cap", False), "hml": ("f_disc", True), "rmw": ("f_qty", True), "cma": ("f_tax", False), "mom": ("target", True)}
PROXY_SQL = f"pt AS (SELECT *, {', '.join(f'median({c}) OVER w AS m_{k}' for k, (c, _) in _PROXY.items())} FROM panel WHERE target IS NOT NULL WINDOW w AS (PARTITION BY month_idx)), pg AS (SELECT month_idx, count(*) AS n, avg(target) - 0.0025 AS mkt, {', '.join(f'coalesce({1 if high else -1} * (avg(target) FILTER ({c} > m_{k}) - avg(target) FILTER ({c} <= m_{k})), 0) AS {k}' for k, (c, high) in _PROXY.items())} FROM pt GROUP BY 1), pf AS (SELECT month_idx, {', '.join(f'CASE WHEN n >= 30 THEN {k} ELSE 0 END AS {k}' for k in ('mkt', *_PROXY))} FROM pg)"


def _excess(s, d, table: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    held = (holdings(s, d, table).filter("is_holding") if of is None else of).filter("target is not null")
    return held.groupBy("series", "month_idx").agg((F.sum(F.col("weight") * F.col("target")) - 0.0025).alias("excess"))


def _regression(s, d, table: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    table = base(s, d) if table is None else table
    factors = attribution.proxy_factors(table, _PROXY)
    return attribution.factor_regression(_excess(s, d, table, of).join(factors, "month_idx"), ["mkt", *_PROXY])


def _regression_sql(ridge: float = 0.01, least: int = 6) -> str:
    """Running sums of products, then the elimination of one unknown after another (the matrix is positive definite)."""
    names = ["mkt", *_PROXY]
    t = ["1.0", *names]
    k = len(t)
    over = "OVER (PARTITION BY series ORDER BY month_idx ROWS UNBOUNDED PRECEDING)"
    sums = [f"sum({t[i]} * {t[j]}) {over} AS g_{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum({t[i]} * excess) {over} AS b_{i}" for i in range(k)]
    g = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    kept = ", ".join(["series", "month_idx", "n", "yy", *[g(i, j) for i in range(k) for j in range(i, k)], *[f"b_{i}" for i in range(k)]])
    steps = [f"e0 AS MATERIALIZED (SELECT {kept}, " + ", ".join(f"{g(i, j)}{f' + {ridge}' if i == j else ''} AS a_{i}_{j}" for i in range(k) for j in range(k)) + ", " + ", ".join(f"b_{i} AS a_{i}_{k}" for i in range(k)) + " FROM gs)"]
    for p in range(k):
        cells = [f"a_{p}_{j} / a_{p}_{p} AS a_{p}_{j}" if i == p else f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" for i in range(k) for j in range(p + 1, k + 1)]
        steps.append(f"e{p + 1} AS MATERIALIZED (SELECT {kept}, {', '.join(cells)} FROM e{p})")
    beta = [f"a_{i}_{k}" for i in range(k)]
    rss = "yy - 2 * (" + " + ".join(f"{beta[i]} * b_{i}" for i in range(k)) + ") + " + " + ".join(f"{beta[i]} * {beta[j]} * {g(i, j)}" for i in range(k) for j in range(k))
    pick = lambda x: f"round(CASE WHEN n < {least} THEN 0 ELSE {x} END, 7)"
    out = ", ".join(f"{pick(beta[i + 1])} AS beta_{n}" for i, n in enumerate(names))
    return (
        f"{H}, {PROXY_SQL}, ex AS (SELECT series, month_idx, sum(weight * target) - 0.0025 AS excess FROM hh WHERE target IS NOT NULL GROUP BY 1, 2), x AS (SELECT * FROM ex JOIN pf USING (month_idx)), "
        f"gs AS (SELECT series, month_idx, count(*) {over} AS n, sum(excess * excess) {over} AS yy, {', '.join(sums)} FROM x), {', '.join(steps)} "
        f"SELECT series, month_idx, {pick(f'12 * {beta[0]}')} AS alpha, {out}, {pick(f'CASE WHEN yy - b_0 * b_0 / n > 1e-12 THEN 1 - ({rss}) / (yy - b_0 * b_0 / n) ELSE 0 END')} AS r2 FROM e{k}"
    )


def _filled(s, d) -> DataFrame:
    """The panel without its latest targets, these taken from a reference that has them under the same names."""
    full = with_target(panel(s, d))
    return ingest.fill_cells(full.select("month_idx", "entity", "target"), full.select("entity", "month_idx", F.coalesce("target", "f_disc").alias("target"), "f_tax"), ["entity", "month_idx"])


QUERIES = {
    "month_end_days": lambda s, d: ingest.month_end_days(_calendar(s, d)),
    "report_period": lambda s, d: _calendar(s, d).distinct().select("date", ingest.report_period(F.col("date")).alias("period")),
    "filter_universe": lambda s, d: ingest.filter_universe(_candidates(s, d), _rules()).select("entity", "month_idx"),
    "reject_counts": lambda s, d: ingest.reject_counts(_candidates(s, d), _rules()),
    "min_cross_section": lambda s, d: panel(s, d).groupBy("month_idx").agg(F.count("*").alias("n")).filter("n >= 15"),
    "join_financials_asof": lambda s, d: rounded(_asof(s, d), 2),
    "adjust_prices": lambda s, d: _adjusted(s, d),
    "recent_bars": lambda s, d: rounded(ingest.recent_bars(bars(s, d)).select("entity", "date", "age", "close")),
    "bars_from_events": lambda s, d: ingest.bars_from_events(table(s, d, "events").select("event_id", "ts", "user_id", "value")),
    "validate_panel": lambda s, d: ingest.validate_months(panel(s, d), ordered(s, d)),
    "incremental_months": lambda s, d: ingest.incremental_months(panel(s, d), ordered(s, d)),
    "industry_universe": lambda s, d: rounded(attribution.industry_universe(panel(s, d)), 9),
    "brinson": lambda s, d: _effects(s, d).select("series", "month_idx", "industry", *[F.round(c, 13).alias(c) for c in EFFECTS]),
    "brinson_rollup": lambda s, d: rounded(attribution.brinson_rollup(_effects(s, d)), 7),
    "proxy_factors": lambda s, d: rounded(attribution.proxy_factors(with_target(panel(s, d)), _PROXY), 7),
    "five_factor": lambda s, d: rounded(_regression(s, d), 7),
    "fill_cells": _filled,
    "barra_exposure": lambda s, d: rounded(attribution.exposures(holdings(s, d).filter("is_holding"), cross.quantile_spread(cross.long_form(with_target(panel(s, d)), STYLES, ["entity", "month_idx", "target"])), STYLES), 7),
    "trial_quantiles": lambda s, d: rounded(trials.metric_quantiles(_trials(s, d)), 8),
    "trial_normalize_static": lambda s, d: rounded(trials.attributes(trials.valid(_trials(s, d))).select("number", "metric", trials.normalize_static(F.col("metric"), F.col("x")).alias("z")), 9),
    "trial_normalize_adaptive": lambda s, d: rounded(_normalized(s, d).select("number", "metric", "z"), 9),
    "trial_scores": lambda s, d: rounded(trials.score(_normalized(s, d), _weights(s)), 8),
    "trial_filter": lambda s, d: trials.filter_trials(_trials(s, d), {"val_ic": (-0.05, 0.08), "sharpe_ratio": (-1.0, 1.0)}).select("number", "value"),
    "trial_metric_ranges": lambda s, d: rounded(trials.metric_ranges(_trials(s, d)), 8),
    "trial_param_ranges": lambda s, d: rounded(trials.param_ranges(_trials(s, d)), 8),
    "trial_health": lambda s, d: trials.health(_trials(s, d)),
    "trial_convergence": lambda s, d: rounded(trials.convergence(_trials(s, d)), 8),
    "trial_top_k": lambda s, d: trials.top_k(_trials(s, d)),
    "trial_warm_start": lambda s, d: trials.warm_start(_trials(s, d), {"val_ic": (-0.05, 0.08), "sharpe_ratio": (-1.0, 1.0)}),
}
_R = lambda cols, n, src: ", ".join(f"round({c}, {n}) AS {c}" for c in cols.split()) + f" FROM {src}"
SQL = {
    "month_end_days": "SELECT strftime(l_shipdate, '%Y%m') AS month, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1",
    "report_period": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, CASE WHEN month(l_shipdate) <= 3 THEN (year(l_shipdate) - 1)::VARCHAR || '1231' WHEN month(l_shipdate) <= 6 THEN year(l_shipdate)::VARCHAR || '0331' WHEN month(l_shipdate) <= 9 THEN year(l_shipdate)::VARCHAR || '0630' ELSE year(l_shipdate)::VARCHAR || '0930' END AS period FROM lineitem",
    "filter_universe": f"{CAND} SELECT entity, month_idx FROM cd WHERE " + " AND ".join(_TESTS.values()),
    "reject_counts": f"{CAND} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({t}, false)) AS rejected FROM cd" for k, t in _TESTS.items()),
    "min_cross_section": f"WITH {PANEL_SQL} SELECT month_idx, count(*) AS n FROM panel0 GROUP BY 1 HAVING count(*) >= 15",
    "join_financials_asof": "WITH st AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS announced, max(o_totalprice) AS value FROM orders GROUP BY 1, 2), l AS (SELECT c_custkey AS entity, date FROM customer, (SELECT CAST(max(l_shipdate) AS DATE) AS date FROM lineitem GROUP BY strftime(l_shipdate, '%Y%m'))) SELECT l.entity, l.date, round(st.value, 2) AS value FROM l ASOF LEFT JOIN st ON l.entity = st.entity AND l.date >= st.announced",
    "adjust_prices": f"WITH {BARS_SQL}, f AS (SELECT entity, date, 1 + dayofyear(date) / 1000 AS adj FROM bars WHERE day(date) <= 10), la AS (SELECT entity, arg_max(adj, date) AS l FROM f GROUP BY 1) SELECT entity, date, " + ", ".join(f"{c} * coalesce(adj / l, 1) AS {c}" for c in ("open", "high", "low", "close")) + " FROM bars LEFT JOIN f USING (entity, date) LEFT JOIN la USING (entity)",
    "recent_bars": f"WITH {BARS_SQL}, r AS (SELECT entity, date, row_number() OVER (PARTITION BY entity ORDER BY date DESC) - 1 AS age, close, count(*) OVER (PARTITION BY entity) AS n FROM bars) SELECT entity, date, age, round(close, 6) AS close FROM r WHERE age < 300 AND n >= 60",
    "bars_from_events": "SELECT user_id, date_trunc('hour', ts) AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "validate_panel": f"WITH {PANEL_SQL}, a AS (SELECT month_idx, entity FROM panel0), b AS ({ORDERED}), j AS (SELECT coalesce(a.month_idx, b.month_idx) AS month_idx, a.entity AS x, b.entity AS y FROM a FULL JOIN b ON a.month_idx = b.month_idx AND a.entity = b.entity) SELECT month_idx, count(x) AS rows, count(y) AS reference_rows, count(*) FILTER (y IS NULL) AS extra_keys, count(*) FILTER (x IS NULL) AS missing_keys, count(*) FILTER (y IS NULL OR x IS NULL) = 0 AS valid FROM j GROUP BY 1",
    "incremental_months": f"WITH {PANEL_SQL} SELECT DISTINCT month_idx FROM panel0 WHERE month_idx NOT IN (SELECT month_idx FROM ({ORDERED}))",
    "industry_universe": f"WITH {PANEL_SQL} SELECT month_idx, industry, round(count(*) / sum(count(*)) OVER (PARTITION BY month_idx), 9) AS w_benchmark FROM panel0 GROUP BY 1, 2",
    "brinson": f"{BR} SELECT series, month_idx, industry, " + ", ".join(f"round({c}, 13) AS {c}" for c in EFFECTS) + " FROM br",
    "brinson_rollup": f"{BR} SELECT series, month_idx, industry, round(sum(allocation), 7) AS allocation, round(sum(selection), 7) AS selection, round(sum(interaction), 7) AS interaction FROM br GROUP BY GROUPING SETS ((series, month_idx), (series, industry), (series))",
    "proxy_factors": f"WITH {PANEL_SQL}, {PROXY_SQL} SELECT month_idx, " + _R(" ".join(("mkt", *_PROXY)), 7, "pf"),
    "five_factor": _regression_sql(),
    "fill_cells": f"WITH {PANEL_SQL} SELECT entity, month_idx, coalesce(target, f_disc) AS target, f_tax FROM panel",
    "barra_exposure": f"{H}, sl AS (UNPIVOT (SELECT month_idx, target, f_disc, f_qty FROM panel WHERE target IS NOT NULL) ON f_disc, f_qty INTO NAME factor VALUE y), sg AS (SELECT month_idx, factor, list_sort(list_distinct(quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM sl GROUP BY 1, 2 HAVING count(*) >= 50), sp AS (SELECT month_idx, factor, avg(CASE WHEN y > ed[-2] THEN target END) - avg(CASE WHEN y <= ed[2] THEN target END) AS spread FROM sl JOIN sg USING (month_idx, factor) WHERE len(ed) > 2 GROUP BY 1, 2), e AS (SELECT series, month_idx, 'f_disc' AS factor, sum(weight * f_disc) / sum(weight) AS exposure FROM hh GROUP BY 1, 2 UNION ALL SELECT series, month_idx, 'f_qty', sum(weight * f_qty) / sum(weight) FROM hh GROUP BY 1, 2) SELECT series, month_idx, factor, round(exposure, 7) AS exposure, round(spread, 7) AS spread, round(exposure * coalesce(spread, 0), 7) AS contribution FROM e LEFT JOIN sp USING (month_idx, factor)",
    "trial_quantiles": f"WITH {TR} SELECT metric, " + _R("p5 p25 p50 p75 p95 min max mean std positive_rate zero_rate missing_rate", 8, "qt"),
    "trial_normalize_static": f"WITH {TR} SELECT number, metric, round(CASE metric WHEN 'val_ic' THEN (greatest(least(coalesce(v, 0), 0.05), -0.05) + 0.05) / 0.1 - 0.5 WHEN 'val_icir' THEN tanh(coalesce(v, 0) / 2) WHEN 'sharpe_ratio' THEN tanh(coalesce(v, 0)) ELSE sign(v) * ln(1 + abs(v)) END, 9) AS z FROM lg",
    "trial_normalize_adaptive": f"WITH {TR} SELECT number, metric, round(z, 9) AS z FROM nz",
    "trial_scores": f"WITH {TR} SELECT number, round(sum(z * CASE metric WHEN 'val_ic' THEN 2.0 WHEN 'sharpe_ratio' THEN -0.5 ELSE 1.0 END), 8) AS score, count(*) FILTER (z <> 0) AS used FROM nz GROUP BY 1",
    "trial_filter": f"WITH {TR} SELECT number, value FROM va WHERE NOT has OR (x / 5 BETWEEN -0.05 AND 0.08 AND (number % 7 = 0 OR x * 3 BETWEEN -1 AND 1))",
    "trial_metric_ranges": f"WITH {TR} SELECT metric, round(CASE WHEN count(v) < 2 THEN NULL WHEN min(v) = max(v) THEN 0 ELSE min(v) - (max(v) - min(v)) * 0.05 END, 8) AS low, round(CASE WHEN count(v) < 2 THEN NULL WHEN min(v) = max(v) THEN 1 ELSE max(v) + (max(v) - min(v)) * 0.05 END, 8) AS high FROM lg GROUP BY 1",
    "trial_param_ranges": f"WITH {TR}, {PR}, rk AS (SELECT number, row_number() OVER (ORDER BY value, number) AS p, count(*) OVER () AS n FROM va), b AS (SELECT pm.* FROM pm JOIN rk USING (number) WHERE p <= greatest(1, floor(n * 0.2))), k AS (SELECT param, v, count(*) AS k FROM b GROUP BY 1, 2), md AS (SELECT param, first(v ORDER BY k DESC, v DESC) AS mode, max(k) / sum(k) AS frequency FROM k GROUP BY 1) SELECT param, round(min(TRY_CAST(v AS DOUBLE)), 4) AS low, round(max(TRY_CAST(v AS DOUBLE)), 4) AS high, CASE WHEN param <> 'size' THEN any_value(md.mode) END AS mode, CASE WHEN param <> 'size' THEN round(any_value(md.frequency), 8) END AS frequency, CASE WHEN param <> 'size' THEN any_value(md.frequency) >= 0.8 END AS fixed FROM b JOIN md USING (param) GROUP BY param",
    "trial_health": f"WITH {TR} SELECT count(*) AS trials, count(*) FILTER (state = 'FAIL') AS failed, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (isn) AS nan_value, count(*) FILTER (value = -999) AS failure_value, count(*) FILTER (NOT has) AS no_metrics, count(*) FILTER (state = 'COMPLETE' AND NOT isn AND value > -999 AND has AND sign(x / 5) * sign(x * x - 0.1) < 0) AS sign_clash, min(CASE WHEN state = 'COMPLETE' AND NOT isn AND value > -999 THEN value END) AS best FROM tr",
    "trial_convergence": f"WITH {TR}, h AS (SELECT number, p_size, CASE WHEN p <= n // 2 THEN 1 WHEN p > n - n // 2 THEN 2 END AS half FROM (SELECT *, row_number() OVER (ORDER BY value, number) AS p, count(*) OVER () AS n FROM va)), g AS (SELECT 'size' AS param, avg(p_size) FILTER (half = 1) AS top_mean, stddev_samp(p_size) FILTER (half = 1) AS top_std, avg(p_size) FILTER (half = 2) AS rest_mean, stddev_samp(p_size) FILTER (half = 2) AS rest_std FROM h) SELECT param, round(top_mean, 8) AS top_mean, round(top_std, 8) AS top_std, round(rest_mean, 8) AS rest_mean, round(rest_std, 8) AS rest_std, coalesce(top_std / rest_std < 0.7 AND top_std / abs(top_mean) < 0.3, false) AS converged FROM g",
    "trial_top_k": f"""WITH {TR} SELECT number, value, '{{"brand":"' || p_brand || '","kind":"' || p_type || '","size":"' || p_size || '"}}' AS params_json FROM va ORDER BY value, number LIMIT 10""",
    "trial_warm_start": f"""WITH {TR} SELECT number, value, '{{"brand":"' || p_brand || '","kind":"' || p_type || '","size":"' || p_size || '"}}' AS params_json FROM va WHERE NOT has OR (x / 5 BETWEEN -0.05 AND 0.08 AND (number % 7 = 0 OR x * 3 BETWEEN -1 AND 1)) ORDER BY value, number LIMIT 3""",
}
