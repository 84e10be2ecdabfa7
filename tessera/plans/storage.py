"""Queries that write datasets and read them back: resumable ingest, validation, CSV and JSON, guards, isolated parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import alignment, isolated
from tessera.sources import files, store
from tessera.sources.tables import PANEL_SQL, panel, read_panel, table, with_target
from tessera.streaming.feeds import scratch, written

from .reports import BR, PROXY_SQL, _effects, _regression
from .strategy import base, held, rounded


def _z(df: DataFrame) -> DataFrame:
    w = W.partitionBy("month")
    return df.withColumn("f_qty", F.when(F.stddev_pop("f_qty").over(w) > 1e-8, (F.col("f_qty") - F.avg("f_qty").over(w)) / F.stddev_pop("f_qty").over(w)).otherwise(0.0))


SCHEMES = {"raw": lambda df: df, "z": _z}


def _ingested(s, d) -> DataFrame:
    """Three deliveries into one panel: the early months, the late ones with a second part of one early month, and nothing new."""
    rows = panel(s, d).select("entity", F.col("pred_month").alias("month"), "close", "f_qty").withColumn("early", F.col("month") < "199501").withColumn("second", (F.col("month") == "199403") & (F.col("entity") % 2 == 0))
    at = scratch(s)
    rows.write.partitionBy("early", "second").parquet(f"{at}/all")
    rows = s.read.parquet(f"{at}/all")
    run = lambda: store.ingest(s, f"{at}/landing", rows.drop("early", "second").schema, f"{at}/panel", f"{at}/state", SCHEMES)
    for delivery in (F.col("early") & ~F.col("second"), ~F.col("early") | F.col("second"), None):
        if delivery is not None:
            rows.filter(delivery).drop("early", "second").write.mode("append").parquet(f"{at}/landing")
        run()
    return read_panel(s, f"{at}/panel", columns=["scheme", "month", "entity", "close", "f_qty"])


def _validated(s, d) -> DataFrame:
    """Months of the panel against themselves with faults by month: gone, new, another key, a column fewer, a narrower type, only another order."""
    df = written(panel(s, d).select("entity", "month_idx", "close", "f_qty", "market_cap"))  # read by every delivery
    at, m = scratch(s), F.col("month_idx") % 7
    df.filter(m != 1).repartition("month_idx").write.partitionBy("month_idx").parquet(f"{at}/reference")
    changed = df.filter(m != 0).repartition("month_idx").withColumn("entity", F.when((m == 2) & (F.col("entity") % 50 == 3), -F.col("entity")).otherwise(F.col("entity")))
    changed.filter(m < 3).write.partitionBy("month_idx").parquet(f"{at}/plain")
    changed.filter(m == 3).drop("market_cap").write.partitionBy("month_idx").parquet(f"{at}/short")
    changed.filter(m == 4).withColumn("f_qty", F.col("f_qty").cast("float")).write.partitionBy("month_idx").parquet(f"{at}/narrow")
    changed.filter(m > 4).repartition(5, F.xxhash64("entity")).write.partitionBy("month_idx").parquet(f"{at}/moved")
    months = sorted(r[0] for r in df.select("month_idx").distinct().collect())  # one row a month
    folder = lambda i: "plain" if i % 7 < 3 else {3: "short", 4: "narrow"}.get(i % 7, "moved")
    own = {str(i): f"{at}/{folder(i)}/month_idx={i}" for i in months if i % 7 != 0}
    return store.validate_dataset(s, own, {str(i): f"{at}/reference/month_idx={i}" for i in months if i % 7 != 1}, ["entity"], ["entity", "close"])


def _exchanged(s, d) -> tuple[list, list]:
    """Orders written as CSV and as JSON, some with a price that is no number, and read again by schema."""
    df = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit('a "b", '), F.col("o_orderstatus"))).alias("note"), F.col("o_orderdate"))
    broken = F.col("o_orderkey") % 11 == 0
    good, bad = [], []
    for kind in ("csv", "json"):
        at = f"{scratch(s)}/{kind}"
        files.write_rows(df.filter(~broken), at, kind)
        files.write_rows(df.filter(broken).withColumn("o_totalprice", F.lit("n/a")), at, kind, mode="append")
        g, b = files.read_rows(s, at, df.schema, kind)
        good.append(g.withColumn("kind", F.lit(kind)))
        bad.append(b.withColumn("kind", F.lit(kind)))
    return good, bad


def _round_trip(s, d) -> DataFrame:
    (a, b), _ = _exchanged(s, d)
    return a.unionByName(b).withColumn("o_orderdate", F.col("o_orderdate").cast("string").substr(1, 10))


def _rejects(s, d) -> DataFrame:
    _, (a, b) = _exchanged(s, d)
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("rejected"), F.count_if(F.col("record").contains("n/a")).alias("named"))


def _guarded(s, d) -> DataFrame:
    df = panel(s, d).select("entity", "month_idx", "pred_month", (F.col("month_idx") * 100 + 20).alias("holding_date"), (F.col("month_idx") * 100 + F.col("entity") % 20).alias("factor_date"))
    return alignment.require_months(alignment.require_no_lookahead(df)).select("entity", "pred_month", "factor_date")


def _parts(s, d) -> DataFrame:
    """The attribution's parts, one of them asking for a column that isn't there."""
    universe = base(s, d)
    h = written(held(s, d, universe))
    parts = {
        "brinson": lambda: _effects(s, d, universe, h), "five_factor": lambda: _regression(s, d, universe, h), "broken": lambda: h.select("no_such_column"),
        "fails_late": lambda: h.select(F.assert_true(F.col("weight") < 0)), "empty": lambda: h.filter("weight > 2"),
    }
    return isolated.run_all(s, parts)[0].select("part", "status", "rows")


QUERIES = {
    "panel_ingest": lambda s, d: rounded(_ingested(s, d)),
    "validate_dataset": _validated,
    "delimited_round_trip": _round_trip,
    "delimited_rejects": _rejects,
    "guarded_months": _guarded,
    "attribution_run_all": _parts,
    "join_new_columns": lambda s, d: alignment.join_new_columns(panel(s, d).select("entity", "month_idx", "close"), with_target(panel(s, d)).select("entity", "month_idx", (-F.col("close")).alias("close"), "f_qty", "target").filter("entity % 3 > 0"), ["entity", "month_idx"]),
}
_ROWS = lambda kind, f: f"SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a \"b\", ' || o_orderstatus END AS note, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, '{kind}' AS kind FROM orders WHERE {f}"
SQL = {
    "panel_ingest": f"WITH {PANEL_SQL} SELECT 'raw' AS scheme, pred_month AS month, entity, round(close, 6) AS close, round(f_qty, 6) AS f_qty FROM panel UNION ALL SELECT 'z', pred_month, entity, round(close, 6), round(CASE WHEN stddev_pop(f_qty) OVER w > 1e-8 THEN (f_qty - avg(f_qty) OVER w) / stddev_pop(f_qty) OVER w ELSE 0 END, 6) FROM panel WINDOW w AS (PARTITION BY pred_month)",
    "validate_dataset": f"""WITH {PANEL_SQL}, m AS (SELECT month_idx AS i, count(*) AS n, count(*) FILTER (entity % 50 = 3) AS c FROM panel0 GROUP BY 1),
v AS (SELECT CAST(i AS VARCHAR) AS unit, n, c, CASE i % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' WHEN 3 THEN 'schema: columns: 3, not 4' WHEN 4 THEN 'schema: type of f_qty: float, not double' WHEN 2 THEN CASE WHEN c > 0 THEN 'keys' ELSE 'ok' END ELSE 'ok' END AS reason, i % 7 < 2 AS one FROM m)
SELECT unit, reason = 'ok' AS valid, reason, CASE WHEN one THEN 0 ELSE n END AS rows, CASE WHEN one THEN 0 ELSE n END AS reference_rows, CASE WHEN reason = 'keys' THEN c ELSE 0 END AS missing_keys, CASE WHEN reason = 'keys' THEN c ELSE 0 END AS extra_keys FROM v""",
    "delimited_round_trip": _ROWS("csv", "o_orderkey % 11 <> 0") + " UNION ALL " + _ROWS("json", "o_orderkey % 11 <> 0"),
    "delimited_rejects": "SELECT k AS kind, count(*) AS rejected, count(*) AS named FROM orders, (VALUES ('csv'), ('json')) t(k) WHERE o_orderkey % 11 = 0 GROUP BY 1",
    "guarded_months": f"WITH {PANEL_SQL} SELECT entity, pred_month, month_idx * 100 + entity % 20 AS factor_date FROM panel",
    "attribution_run_all": f"{BR}, {PROXY_SQL} SELECT 'brinson' AS part, 'ok' AS status, count(*) AS rows FROM br UNION ALL SELECT 'five_factor', 'ok', count(*) FROM (SELECT DISTINCT series, month_idx FROM hh WHERE target IS NOT NULL) UNION ALL SELECT 'broken', 'failed', 0 UNION ALL SELECT 'fails_late', 'failed', 0 UNION ALL SELECT 'empty', 'empty', 0",
    "join_new_columns": f"WITH {PANEL_SQL} SELECT entity, month_idx, close, CASE WHEN entity % 3 > 0 THEN f_qty END AS f_qty, CASE WHEN entity % 3 > 0 THEN target END AS target FROM panel",
}
