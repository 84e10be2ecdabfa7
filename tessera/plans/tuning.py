"""Queries on tuning studies with the full set of metrics: scores, health, gate, ranges, convergence, advice, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import selection, trials
from tessera.sources.tables import table
from tessera.streaming.feeds import written

from .strategy import rounded

WEIGHTS = {"val_ic": (2.0, "max"), "val_icir": (1.0, "max"), "val_rolling6m_ir": (1.5, "max"), "pct_positive_excess": (1.0, "max"), "penalized_rate": (0.5, "min"), "ic_gap_penalty": (1.0, "min"), "val_sqn": (0.2, "max"), "max_drawdown": (0.3, "max")}
RANGES = {"val_ic": (-0.1, 0.2), "val_global_ir": (0.0, 0.6)}
KINDS = {"categorical": ("kind", "flag")}
WHOLE = ("depth", "leaf")


def study(s, d) -> DataFrame:
    """One trial a part, with every kind of fault that trials have."""
    p, key = table(s, d, "part").repartition("p_partkey"), F.col("p_partkey")  # a small file is one task's, its trials aren't
    x, y = ((key * 37) % 101 - 50) / 100, ((key * 53) % 97) / 97
    nan, nothing = F.lit(float("nan")), F.lit(None).cast("double")
    metrics = {
        "val_ic": x / 2, "val_icir": F.when(key % 13 != 0, x * x * 4 - 0.2), "val_rolling6m_ir": F.when(key % 17 == 0, nan).when(key % 43 == 0, (y - 0.2) * 100).otherwise(y - 0.2),
        "val_global_ir": y * 0.8 - 0.1, "pct_positive_excess": 0.3 + y * 0.5, "penalized_rate": F.when(key % 11 != 0, y * 0.6), "ic_gap_penalty": F.abs(x), "max_drawdown": F.when(key % 47 == 0, nothing).otherwise(-y), "elapsed_sec": (key % 50).cast("double"),
    }
    params = {"depth": (F.col("p_size") % 8 + 2).cast("string"), "leaf": (F.col("p_size") / 4).cast("string"), "rate": (0.1 + y / 50).cast("string"), "kind": F.split("p_type", " ")[0], "flag": F.when(key % 12 == 0, "false").otherwise("true")}
    pairs = lambda m: F.create_map(*[v for k, c in m.items() for v in (F.lit(k), c)])
    return written(p.select(
        key.alias("number"), F.when(key % 29 == 0, "FAIL").when(key % 31 == 0, "RUNNING").otherwise("COMPLETE").alias("state"),
        F.when(key % 23 == 0, nan).when(key % 19 == 0, -999.0).when(key % 37 == 0, float("inf")).otherwise(F.round(2 * x + y, 6)).alias("value"),
        pairs(params).alias("params"), F.when(key % 41 != 0, pairs(metrics)).otherwise(F.create_map().cast("map<string,double>")).alias("attrs"),
    ))


def _stage1(s, d) -> DataFrame:
    return selection.completed(study(s, d)).filter("value < double('inf')")


def _stage2(s, d, one: DataFrame | None = None) -> DataFrame:
    one = _stage1(s, d) if one is None else one
    return selection.quality_gate(one, selection.standard_rules(one))


def _advice(s, d) -> DataFrame:
    return trials.search_advice(_stage2(s, d), whole=WHOLE, **KINDS)


def _verdict(s, d) -> DataFrame:
    one = _stage1(s, d)
    two = _stage2(s, d, one)
    return selection.verdict(two, one, trials.search_advice(two, whole=WHOLE, **KINDS))


def _scores(s, d) -> DataFrame:
    df = study(s, d)
    return trials.score_trials(df, WEIGHTS, trials.metric_quantiles(df.filter("number % 2 = 0")).filter("metric <> 'ic_gap_penalty'"), trials.metric_quantiles(df))


QUERIES = {
    "study_scores": lambda s, d: rounded(_scores(s, d), 7),
    "study_raw_scores": lambda s, d: rounded(trials.score_trials(study(s, d), WEIGHTS), 7),
    "study_health": lambda s, d: rounded(trials.study_health(study(s, d)), 7),
    "study_count_matched": lambda s, d: trials.count_matched(study(s, d), RANGES),
    "study_gate": lambda s, d: _stage2(s, d).select("number", "value"),
    "study_param_ranges": lambda s, d: rounded(trials.param_ranges(trials.filter_trials(study(s, d), RANGES), 0.1, ascending=False, whole=WHOLE), 6),
    "study_convergence": lambda s, d: rounded(trials.convergence(_stage2(s, d), **KINDS), 7),
    "study_advice": lambda s, d: rounded(_advice(s, d), 5),
    "study_verdict": lambda s, d: rounded(_verdict(s, d), 7),
}

_ST = """st AS (SELECT *, CASE WHEN k % 13 <> 0 THEN x * x * 4 - 0.2 END AS icir, CASE WHEN k % 17 = 0 THEN 'nan'::DOUBLE WHEN k % 43 = 0 THEN (y - 0.2) * 100 ELSE y - 0.2 END AS roll, y * 0.8 - 0.1 AS gl, 0.3 + y * 0.5 AS pos, CASE WHEN k % 11 <> 0 THEN y * 0.6 END AS pen, CASE WHEN k % 47 <> 0 THEN -y END AS mdd,
  k % 41 <> 0 AS has, CASE WHEN k % 29 = 0 THEN 'FAIL' WHEN k % 31 = 0 THEN 'RUNNING' ELSE 'COMPLETE' END AS state, CASE WHEN k % 23 = 0 THEN 'nan'::DOUBLE WHEN k % 19 = 0 THEN -999.0 WHEN k % 37 = 0 THEN 'inf'::DOUBLE ELSE round(2 * x + y, 6) END AS value
  FROM (SELECT p_partkey AS k, ((p_partkey * 37) % 101 - 50) / 100 AS x, ((p_partkey * 53) % 97) / 97 AS y, p_size, string_split(p_type, ' ')[1] AS kind, CASE WHEN p_partkey % 12 = 0 THEN 'false' ELSE 'true' END AS flag FROM part)),
va AS (SELECT * FROM st WHERE state = 'COMPLETE' AND isfinite(value) AND value > -999)"""
_M = {"val_ic": "x / 2", "val_icir": "icir", "val_rolling6m_ir": "roll", "val_global_ir": "gl", "pct_positive_excess": "pos", "penalized_rate": "pen", "ic_gap_penalty": "abs(x)", "max_drawdown": "mdd", "elapsed_sec": "CAST(k % 50 AS DOUBLE)"}
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT k, '{m}' AS metric, CASE WHEN NOT isnan({c}) THEN {c} END AS v FROM va WHERE has" for m, c in _M.items()) + ")"
_QT = lambda name, where: f"{name} AS (SELECT metric, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, avg(CAST(v = 0 AS DOUBLE)) AS zr, avg(CAST(v IS NULL AS DOUBLE)) AS mr FROM lg WHERE {where} GROUP BY 1)"
_W = ", ".join(f"('{m}', {w * (1.5 if m == 'ic_gap_penalty' else 1) * (1 if d == 'max' else -1)}::DOUBLE, {m in trials.LINEAR})" for m, (w, d) in WEIGHTS.items())
_TERMS = "tm AS (" + " UNION ALL ".join(f"SELECT k, '{m}' AS metric, CASE WHEN has THEN coalesce({_M.get(m, 'NULL::DOUBLE')}, 0) ELSE 0 END AS v FROM va" for m in WEIGHTS) + f"), w(metric, w, lin) AS (VALUES {_W})"
_S1 = "s1 AS (SELECT * FROM st WHERE state = 'COMPLETE' AND isfinite(value) AND value > -900)"
_S2 = "s2 AS (SELECT * FROM s1 WHERE has AND NOT isnan(roll) AND roll > 0.05 AND gl > 0.05 AND pos > 0.5 AND pen < 0.5)"
_PARAMS = lambda src: f"pm AS (SELECT k, value, 'depth' AS param, CAST(p_size % 8 + 2 AS DOUBLE) AS n, NULL AS v FROM {src} UNION ALL SELECT k, value, 'leaf', p_size / 4, NULL FROM {src} UNION ALL SELECT k, value, 'rate', 0.1 + y / 50, NULL FROM {src} UNION ALL SELECT k, value, 'kind', NULL, kind FROM {src} UNION ALL SELECT k, value, 'flag', NULL, flag FROM {src})"
_BEST = lambda src, share, order="": f"rk AS (SELECT *, row_number() OVER (ORDER BY value {order}, k) AS p, count(*) OVER () AS n FROM {src}), be AS (SELECT * EXCLUDE (p, n) FROM rk WHERE p <= greatest(1, floor(n * {share} + 1e-9)))"
_MODE = "md AS (SELECT param, first(v ORDER BY c DESC, v DESC) AS mode, max(c) / sum(c) AS frequency FROM (SELECT param, v, count(*) AS c FROM {0} WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
_ADVICE = f"""WITH {_ST}, {_S1}, {_S2}, {_BEST("s2", 0.25)}, {_PARAMS("be")}, {_MODE.format("pm")},
nm AS (SELECT param, avg(n) AS m, stddev_samp(n) AS s FROM pm WHERE n IS NOT NULL GROUP BY 1), fx AS (SELECT *, s / (abs(m) + 1e-8) < 0.15 AS f FROM nm),
ad AS (SELECT param, CASE WHEN f THEN 'fix' ELSE 'range' END AS advice, CASE WHEN param IN ('depth', 'leaf') THEN greatest(round(CASE WHEN f THEN m ELSE m - s END), 0) ELSE round(CASE WHEN f THEN m ELSE m - s END, 5) END AS low, CASE WHEN param IN ('depth', 'leaf') THEN greatest(round(CASE WHEN f THEN m ELSE m + s END), 0) ELSE round(CASE WHEN f THEN m ELSE m + s END, 5) END AS high, NULL::VARCHAR AS mode FROM fx
 UNION ALL SELECT param, CASE WHEN frequency > 0.8 THEN 'fix' ELSE 'search' END, NULL, NULL, mode FROM md)"""
SQL = {
    "study_scores": f"""WITH {_ST}, {_LONG}, {_QT("qa", "k % 2 = 0 AND metric <> 'ic_gap_penalty'")}, {_QT("qo", "true")}, qt AS (SELECT * FROM qa UNION ALL SELECT * FROM qo WHERE metric NOT IN (SELECT metric FROM qa)), {_TERMS},
z AS (SELECT tm.k, tm.v, w.w, coalesce(zr > 0.9 OR mr > 0.9, false) AS bad, CASE WHEN coalesce(zr > 0.9 OR mr > 0.9, false) OR isnan(v) THEN 0 WHEN qt.metric IS NULL THEN tanh(v / 2) WHEN lin THEN (greatest(least(v, p95), p5) - p5) / greatest(p95 - p5, 1e-6) - 0.5 ELSE tanh((v - p50) / greatest((p95 - p5) / 2, 1e-6)) END AS z FROM tm JOIN w USING (metric) LEFT JOIN qt USING (metric))
SELECT k AS number, round(sum(w * v), 7) AS raw_score, round(sum(w * z), 7) AS score, count(*) FILTER (NOT bad) AS metrics FROM z GROUP BY 1""",
    "study_raw_scores": f"WITH {_ST}, {_TERMS} SELECT k AS number, round(sum(w * v), 7) AS raw_score, CASE WHEN isfinite(sum(w * v)) THEN round(sum(w * v), 7) ELSE -1000.0 END AS score, count(*) AS metrics FROM tm JOIN w USING (metric) GROUP BY 1",
    "study_health": f"""WITH {_ST}, dg AS (SELECT *, CASE WHEN state = 'FAIL' THEN 'failed' WHEN state <> 'COMPLETE' THEN 'running' WHEN NOT isfinite(value) THEN 'not_finite' WHEN value <= -999 THEN 'failure_value' WHEN NOT has THEN 'no_metrics' WHEN isnan(roll) THEN 'bad_metric'
 WHEN abs(x / 2) > 0.1 AND (x > 0) <> (icir > 0) THEN 'sign_clash' WHEN abs(gl) > 1e-6 AND abs(roll) / abs(gl) > 10 THEN 'ratio' ELSE 'ok' END AS diagnosis, CASE WHEN state = 'COMPLETE' AND has AND k % 50 > 0 THEN CAST(k % 50 AS DOUBLE) END AS sec FROM st)
SELECT diagnosis, count(*) AS trials, round(min(value) FILTER (diagnosis = 'ok'), 7) AS best, count(sec) AS timed, round(sum(sec), 7) AS seconds, round(avg(sec), 7) AS mean_seconds, min(sec) AS least_seconds, max(sec) AS most_seconds FROM dg GROUP BY 1""",
    "study_count_matched": f"WITH {_ST} SELECT count(*) FILTER (NOT has OR (x / 2 BETWEEN -0.1 AND 0.2 AND gl BETWEEN 0.0 AND 0.6)) AS matched, count(*) AS total FROM va",
    "study_gate": f"WITH {_ST}, {_S1}, {_S2} SELECT k AS number, value FROM s2",
    "study_param_ranges": f"""WITH {_ST}, ma AS (SELECT * FROM va WHERE NOT has OR (x / 2 BETWEEN -0.1 AND 0.2 AND gl BETWEEN 0.0 AND 0.6)), {_BEST("ma", 0.1, "DESC")}, {_PARAMS("be")}, {_MODE.format("pm")}
SELECT param, CASE WHEN param IN ('depth', 'leaf') THEN floor(min(n)) ELSE round(min(n), 4) END AS low, CASE WHEN param IN ('depth', 'leaf') THEN ceil(max(n)) ELSE round(max(n), 4) END AS high, any_value(md.mode) AS mode, round(any_value(frequency), 6) AS frequency, any_value(frequency) >= 0.8 AS fixed FROM pm LEFT JOIN md USING (param) GROUP BY 1""",
    "study_convergence": f"""WITH {_ST}, {_S1}, {_S2}, rk AS (SELECT *, CASE WHEN p <= n // 2 THEN 1 WHEN p > n - n // 2 THEN 2 END AS half FROM (SELECT *, row_number() OVER (ORDER BY value, k) AS p, count(*) OVER () AS n FROM s2)), {_PARAMS("rk")}, pq AS (SELECT pm.*, half FROM pm JOIN rk USING (k)), tp AS (SELECT * FROM pq WHERE half = 1), {_MODE.format("tp")},
g AS (SELECT param, avg(n) FILTER (half = 1) AS a, stddev_samp(n) FILTER (half = 1) AS b, avg(n) FILTER (half = 2) AS c, stddev_samp(n) FILTER (half = 2) AS e FROM pq WHERE n IS NOT NULL GROUP BY 1)
SELECT param, round(a, 7) AS top_mean, round(b, 7) AS top_std, round(c, 7) AS rest_mean, round(e, 7) AS rest_std, coalesce(b / e < 0.7 AND b / (abs(a) + 1e-8) < 0.3, false) AS converged, NULL::VARCHAR AS mode, NULL::DOUBLE AS frequency FROM g UNION ALL SELECT param, NULL, NULL, NULL, NULL, NULL, mode, round(frequency, 7) FROM md""",
    "study_advice": f"{_ADVICE} SELECT * FROM ad",
    "study_verdict": f"{_ADVICE}, c AS (SELECT (SELECT count(*) FROM s1) AS trials, (SELECT count(*) FROM s2) AS qualified, (SELECT avg(CAST(advice = 'fix' AS DOUBLE)) FROM ad) AS r) SELECT trials, qualified, round(qualified / trials, 7) AS pass_rate, round(r, 7) AS convergence, CASE WHEN qualified >= 30 AND (qualified / trials > 0.5 OR r >= 0.7) THEN 'GO' ELSE 'RERUN' END AS verdict FROM c",
}
