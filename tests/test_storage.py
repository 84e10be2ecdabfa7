"""Stored panels: deliveries, restarts, failing units, validation of datasets, CSV and JSON, guards, isolated parts, sketches."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment, attribution, fundamentals, isolated, selection, sketches, validation
from tessera.sources import files, ingest, store
from tessera.sources.tables import read_panel

SCHEMA = "entity bigint, month string, x double"


def land(spark, rows, at):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{at}/landing")


def brought(spark, at, schemes=None, **options):
    store.ingest(spark, f"{at}/landing", spark.createDataFrame([], SCHEMA).schema, f"{at}/panel", f"{at}/state", schemes or {"raw": lambda df: df}, **options)
    return sorted((r.scheme, r.month, r.entity, r.x) for r in read_panel(spark, f"{at}/panel").collect())


def test_deliveries_restarts_and_late_files(spark, tmp_path):
    at = str(tmp_path)
    land(spark, [(1, "202001", 1.0), (2, "202001", float("nan")), (1, "202002", 2.0)], at)
    first = [("raw", "202001", 1, 1.0), ("raw", "202001", 2, None), ("raw", "202002", 1, 2.0)]
    assert brought(spark, at) == first and brought(spark, at) == first  # nothing new
    land(spark, [(3, "202001", 9.0)], at)  # late, for an old month
    land(spark, [(1, "202003", 3.0)], at)
    both = sorted([*first, ("raw", "202001", 3, 9.0), ("raw", "202003", 1, 3.0)])
    assert brought(spark, at, files_at_once=1) == both
    again = f"{at}/panel"
    assert {r.month for r in read_panel(spark, again, last_n=2).collect()} == {"202002", "202003"}
    assert {r.month for r in read_panel(spark, again, months=["202001"]).collect()} == {"202001"} and read_panel(spark, again, columns=["entity", "month"]).columns == ["entity", "month"]
    # a lost checkpoint replays every file, and still no row is there twice
    store.ingest(spark, f"{at}/landing", spark.createDataFrame([], SCHEMA).schema, f"{at}/panel", f"{at}/other_state", {"raw": lambda df: df})
    assert brought(spark, at) == both
    assert sorted(r.month for r in ingest.month_list(spark, "202001", "202003").collect()) == ["202001", "202002", "202003"]


def test_failing_units_are_listed_and_the_others_stay(spark, tmp_path):
    at = str(tmp_path)
    land(spark, [(1, "202001", 1.0), (1, "202002", -2.0)], at)
    root = lambda df: df.withColumn("x", F.when(F.col("x") < 0, F.raise_error(F.lit("negative"))).otherwise(F.sqrt("x")))
    assert brought(spark, at, {"raw": lambda df: df, "root": root}) == [("raw", "202001", 1, 1.0), ("raw", "202002", 1, -2.0), ("root", "202001", 1, 1.0)]
    (bad,) = spark.read.parquet(f"{at}/panel_failures").collect()
    assert (bad.scheme, bad.month) == ("root", "202002") and "negative" in bad.error


def test_dataset_against_reference(spark, tmp_path):
    at = str(tmp_path)
    df = spark.range(40).select(F.col("id").alias("entity"), (F.col("id") * 1.5).alias("x"), F.lit("a").alias("y"))
    same, moved = f"{at}/a", f"{at}/b"
    df.write.parquet(same)
    df.orderBy(F.desc("entity")).repartition(3).write.parquet(moved)
    df.withColumn("entity", F.when(F.col("entity") == 7, 99).otherwise(F.col("entity"))).write.parquet(f"{at}/c")
    df.select("x", "entity").write.parquet(f"{at}/d")
    df.drop("entity").write.parquet(f"{at}/e")
    df.limit(0).write.parquet(f"{at}/f")
    df.union(df.limit(1)).write.parquet(f"{at}/g")
    own = {"1": moved, "2": f"{at}/c", "3": f"{at}/d", "4": same, "6": f"{at}/e", "7": f"{at}/f", "8": f"{at}/g"}
    got = {r.unit: r for r in store.validate_dataset(spark, own, {u: same for u in ("1", "2", "3", "5", "6", "7", "8")}, ["entity"], ["entity"]).collect()}
    assert got["1"].valid and got["1"].rows == 40
    assert (got["2"].reason, got["2"].missing_keys, got["2"].extra_keys) == ("keys", 1, 1)
    assert "columns: 2, not 3" in got["3"].reason and "order" in got["3"].reason and not got["3"].valid
    assert (got["4"].reason, got["5"].reason) == ("extra", "missing") and "absent: entity" in got["6"].reason
    assert (got["7"].reason, got["7"].missing_keys) == ("keys", 40) and (got["8"].reason, got["8"].rows) == ("keys", 41)
    assert store.manifest(spark, same).agg(F.sum("rows")).first()[0] == 40


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_rows_come_back_and_bad_records_are_kept(spark, tmp_path, kind):
    at = str(tmp_path / kind)
    rows = [(1, 'a "quoted", text', 1.5, True), (2, "", None, None), (3, None, float("inf"), False), (4, " spaced ", -0.25, True), (5, "\\N x", 1e300, True)]
    df = spark.createDataFrame(rows, "id bigint, t string, x double, b boolean")
    files.write_rows(df, at, kind)
    bad = ["oops,t,1.0,true", "7,t", "8,t,1.0,perhaps"] if kind == "csv" else ['{"id": "oops"}', "{broken", '{"id": 8, "b": "perhaps"}']
    spark.createDataFrame([(b,) for b in bad] + [("",)], "value string").write.mode("append").text(at)
    good, rejects = files.read_rows(spark, at, df.schema, kind)
    assert sorted(map(tuple, good.collect())) == rows and good.schema == df.schema
    assert sorted(r.record for r in rejects.collect()) == sorted(bad) and rejects.count() == 3
    with pytest.raises(ValueError):
        files.read_rows(spark, at, df.schema, "xml")


def test_guards_raise(spark):
    df = spark.createDataFrame([(1, "202001", 5, 4), (2, "202002", 5, 5)], "entity int, pred_month string, holding_date int, factor_date int")
    assert alignment.require_months(alignment.require_no_lookahead(df)).count() == 2
    late = df.withColumn("factor_date", F.col("factor_date") + 1)
    with pytest.raises(Exception, match="factor of 6 used on 5"):
        alignment.require_no_lookahead(late).collect()
    for month in ("202013", "20201", None):
        with pytest.raises(Exception, match="not a month"):
            alignment.require_months(df.withColumn("pred_month", F.lit(month).cast("string"))).collect()


def test_a_broken_part_leaves_the_others(spark):
    status, results = isolated.run_all(spark, {"a": lambda: spark.range(3), "b": lambda: spark.range(3).select("nothing"), "c": lambda: spark.range(2).select(F.raise_error(F.lit("late"))), "d": lambda: spark.range(0)})
    assert {(r.part, r.status, r.rows) for r in status.collect()} == {("a", "ok", 3), ("b", "failed", 0), ("c", "failed", 0), ("d", "empty", 0)} and set(results) == {"a", "d"}


def test_new_columns_only(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 9, 7), (2, 9, 8)], "k int, x int, y int")
    assert [tuple(r) for r in alignment.join_new_columns(a, b, ["k"]).collect()] == [(1, 2, 7)]


def test_months_without_a_universe_share_evenly(spark):
    h = spark.createDataFrame([("s", 1, "a", 0.5, 0.1), ("s", 1, "b", 0.5, 0.2)], "series string, month_idx int, industry string, weight double, target double")
    none = spark.createDataFrame([], "month_idx int, industry string, target double")
    assert {r.w_benchmark for r in attribution.brinson(h, none).collect()} == {0.5}


def test_freed_weight_is_an_industry_without_selection(spark):
    done = spark.createDataFrame([(1, 1, 0.4, False, "HOLD"), (2, 1, 0.6, True, "SELL"), (3, 2, 1.0, False, "HOLD")], "entity long, seq int, weight double, sold boolean, label string")
    table = spark.createDataFrame([(1, 1, "a", 0.1), (2, 1, "b", 0.3), (3, 2, "b", None)], "entity long, month_idx long, industry string, target double")
    h = attribution.overlaid(selection.with_cash(done), table)
    assert {r.month_idx: r.w for r in h.groupBy("month_idx").agg(F.round(F.sum("weight"), 9).alias("w")).collect()} == {1: 1.0, 2: 1.0}
    got = {(r.month_idx, r.industry): r for r in attribution.brinson(h, table).collect()}
    cash = got[1, "CASH_POOL"]
    assert (cash.selection, cash.interaction, cash.w_benchmark) == (0.0, 0.0, 0.0) and abs(cash.r_port - 0.025 / 12) < 1e-12
    assert abs(cash.allocation - 0.6 * (0 - 0.2)) < 1e-12 and set(got) == {(1, "a"), (1, "CASH_POOL"), (2, "b")} and got[2, "b"].r_port == 0.0


def test_passed_columns_are_null_without_a_source(spark):
    row = fundamentals.passed(spark.createDataFrame([("1.5", "none")], "pe string, roe string")).first()
    assert row.sup_val_pe_ttm == 1.5 and row.sup_fin_roe_ttm is None and row.sup_val_pb is None and set(fundamentals.PASSED) < set(row.asDict())


def test_sketches_stay_within_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 6).cast("int").alias("month_idx"), (F.col("id") % 7001).alias("entity"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("x"))
    windows = spark.createDataFrame([(w, m, "train") for w in (0, 1) for m in range(w, w + 5)], "window_id int, month_idx int, split string")
    found = sketches.estimates(sketches.merged(sketches.month_states(df, ["x"]), windows, ["x"]), ["x"])
    rows = sketches.within_bounds(df, windows, found, ["x"]).collect()
    assert len(rows) == 2 and all(r.keys_ok and r.quantiles_ok and r.rows == 50_000 for r in rows)
    wrong = found.withColumn("x_q", F.transform("x_q", lambda q: q + 5000)).withColumn("distinct_keys", F.col("distinct_keys") * 2)
    assert not any(r.keys_ok or r.quantiles_ok for r in sketches.within_bounds(df, windows, wrong, ["x"]).collect())


def test_few_validation_months_measure_nothing(spark):
    months = spark.createDataFrame([("s", i, 0.1, 0.0, 0.2) for i in range(5)], "series string, month_idx int, net_return double, benchmark_return double, rate double")
    ics = spark.createDataFrame([], "series string, month_idx int, ic double")
    row = validation.measures(months, ics).first().asDict()
    assert row.pop("series") == "s" and row.pop("months") == 5 and set(row.values()) == {0.0}
