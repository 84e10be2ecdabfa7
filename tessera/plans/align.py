"""Queries on alignment, backfills and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alignment, metrics, overlay, portfolio, trials
from tessera.sources.tables import BARS_SQL, PANEL_SQL, bars, clean, panel, table, with_target

from .cross import _PAIRS, _ic
from .reports import ORDERED, TR, _trials, ordered
from .strategy import M, O, _overlay_input, base, monthly, rounded


def _returns(s, d):
    df = alignment.returns_matrix(bars(s, d))
    return df.select("entity", F.posexplode("returns").alias("age", "r")).select("entity", "age", F.round("r", 8).alias("r"))


def _backfilled(s, d):
    df = with_target(panel(s, d)).select("entity", "month_idx", "target")
    some = df.withColumn("target", F.when(F.col("entity") % 4 != 1, F.col("target")))
    return alignment.backfill(some, df.filter("entity % 8 = 1"), df.withColumn("target", -F.col("target")))


def _guard(s, d):
    df = panel(s, d).select("entity", "month_idx", (F.col("month_idx") * 100 + 20).alias("holding_date"))
    return alignment.lookahead_violations(df, df.select("entity", "month_idx", (F.col("month_idx") * 100 + F.col("entity") % 23).alias("factor_date")))


def _overlay_returns(s, d):
    universe = base(s, d)
    targets = universe.select("entity", F.col("month_idx").cast("int").alias("seq"), "target")
    return alignment.overlay_returns(overlay.run(_overlay_input(s, d, universe)), targets)


def _gap(s, d):
    return alignment.ic_gap(_ic(s, d), portfolio.rolling_windows(panel(s, d)))


def _sanitized(s, d):
    raw = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "n/a").when(F.col("p_partkey") % 7 == 0, "NaN").otherwise(F.col("p_size").cast("string")).alias("t"))
    return clean(raw.select("p_partkey", F.expr("try_cast(t as double)").alias("x")))


QUERIES = {
    "key_intersection": lambda s, d: alignment.key_intersection(table(s, d, "part").select(F.col("p_partkey").alias("entity")), panel(s, d), ordered(s, d)),
    "month_alignment": lambda s, d: alignment.month_alignment(panel(s, d), ordered(s, d)),
    "lookahead_guard": _guard,
    "returns_backfill": lambda s, d: rounded(_backfilled(s, d), 8),
    "returns_matrix": _returns,
    "sanitize": _sanitized,
    "overlay_returns": lambda s, d: rounded(_overlay_returns(s, d), 7),
    "extreme_months": lambda s, d: rounded(alignment.extremes(metrics.curves(monthly(s, d))), 7),
    "ic_gap": lambda s, d: rounded(_gap(s, d), 7),
    "trial_range_advice": lambda s, d: rounded(alignment.range_advice(trials.convergence(_trials(s, d))), 7),
}
SQL = {
    "key_intersection": f"WITH {PANEL_SQL} SELECT p_partkey AS entity FROM part WHERE p_partkey IN (SELECT entity FROM panel0) AND p_partkey IN (SELECT entity FROM ({ORDERED}))",
    "month_alignment": f"WITH {PANEL_SQL}, a AS (SELECT DISTINCT month_idx FROM panel0), b AS (SELECT DISTINCT month_idx FROM ({ORDERED})) SELECT coalesce(a.month_idx, b.month_idx) AS month_idx, a.month_idx IS NOT NULL AS in_a, b.month_idx IS NOT NULL AS in_b FROM a FULL JOIN b ON a.month_idx = b.month_idx",
    "lookahead_guard": f"WITH {PANEL_SQL} SELECT month_idx, count(*) AS pairs, count(*) FILTER (entity % 23 > 20) AS violations FROM panel0 GROUP BY 1",
    "returns_backfill": f"WITH {PANEL_SQL} SELECT entity, month_idx, round(CASE WHEN entity % 4 <> 1 THEN coalesce(target, -target) WHEN entity % 8 = 1 THEN coalesce(target, -target) ELSE -target END, 8) AS target FROM panel",
    "returns_matrix": f"WITH {BARS_SQL}, r AS (SELECT entity, row_number() OVER w - 1 AS age, close, lead(close) OVER w AS old, count(*) OVER (PARTITION BY entity) AS n FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date DESC)) SELECT entity, age, round(ln(close / old), 8) AS r FROM r WHERE age < 60 AND n >= 61",
    "sanitize": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS x FROM part",
    "overlay_returns": f"{O} SELECT f.seq, round(sum(0.01 * CASE WHEN sold THEN 0.025 / 12 ELSE coalesce(target, 0) END), 7) AS ret, round(sum(CASE WHEN sold THEN 0.01::DOUBLE ELSE 0::DOUBLE END), 7) AS cash FROM f JOIN panel p ON p.entity = f.entity AND p.month_idx = f.seq GROUP BY 1",
    "extreme_months": f"{M}, z AS (SELECT series, month_idx, cum, row_number() OVER (PARTITION BY series ORDER BY cum DESC, month_idx) AS high, row_number() OVER (PARTITION BY series ORDER BY cum, month_idx) AS low FROM cv) SELECT series, month_idx, round(cum, 7) AS cum, high, low FROM z WHERE high <= 5 OR low <= 5",
    "ic_gap": f"{_PAIRS}, mo AS (SELECT month_idx, row_number() OVER (ORDER BY month_idx) - 1 AS pos, count(*) OVER () AS k FROM (SELECT DISTINCT month_idx FROM panel)), wi AS (SELECT w AS window_id, month_idx, pos - w AS off FROM mo, generate_series(0, 200) g(w) WHERE w <= k - 49 AND pos BETWEEN w AND w + 47), a AS (SELECT window_id, factor, arg_max(ic, month_idx) AS train_ic FROM ic JOIN wi USING (month_idx) WHERE off < 36 GROUP BY 1, 2), b AS (SELECT window_id, factor, avg(ic) AS val_ic FROM ic JOIN wi USING (month_idx) WHERE off >= 36 GROUP BY 1, 2) SELECT window_id, factor, round(train_ic, 7) AS train_ic, round(val_ic, 7) AS val_ic, round(train_ic - val_ic, 7) AS gap, CASE WHEN train_ic - val_ic > 0.15 THEN 'LOW' ELSE 'OK' END AS confidence FROM a JOIN b USING (window_id, factor)",
    "trial_range_advice": f"WITH {TR}, h AS (SELECT p_size, CASE WHEN p <= n // 2 THEN 1 END AS half FROM (SELECT *, row_number() OVER (ORDER BY value, number) AS p, count(*) OVER () AS n FROM va)), g AS (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s FROM h WHERE half = 1) SELECT 'size' AS param, CASE WHEN s / abs(m) < 0.15 THEN 'fix' ELSE 'search' END AS advice, round(m - 2 * s, 7) AS low, round(m + 2 * s, 7) AS high FROM g",
}
