"""Panels as stored datasets: resumable ingest of arriving files, and checks of a dataset against a reference."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .ingest import schema_problems, write_panel

Scheme = Callable[[DataFrame], DataFrame]


def ingest(spark: SparkSession, landing: str, schema: StructType, target: str, state: str, schemes: dict[str, Scheme], month: str = "month", files_at_once: int | None = None) -> None:
    """Brings what has landed since the last run into the panel at `target`, by scheme and month, and ends (availableNow).

    The stream of files only tells which months have changed. These are built anew from all files of the month and replace
    the partition (dynamic overwrite), so a restart, a repeated batch, or a late file for an old month gives no row
    twice and loses none; months without new files aren't read. A unit of scheme and month that fails is listed in
    `target`_failures with its batch and cause, and the others go on.
    """
    stream = spark.readStream.schema(schema)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)

    def build(scheme: str, months: list[str]) -> None:
        rows = spark.read.schema(schema).parquet(landing).filter(F.col(month).isin(months))
        done = schemes[scheme](rows).withColumn("scheme", F.lit(scheme))
        write_panel(done if month == "month" else done.withColumnRenamed(month, "month"), target)

    def keep(batch: DataFrame, number: int) -> None:
        months = sorted(r[0] for r in batch.select(month).distinct().collect() if r[0] is not None)  # one row a month
        failures = []
        for scheme in schemes if months else ():
            try:
                build(scheme, months)
            except Exception:  # one of the months, perhaps: each on its own, so that it alone is missing
                for m in months:
                    try:
                        build(scheme, [m])
                    except Exception as error:
                        failures.append((number, scheme, m, str(error).split("\n")[0][:500]))
        if failures:
            spark.createDataFrame(failures, "batch long, scheme string, month string, error string").withColumn("part", F.col("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{target}_failures")

    stream.parquet(landing).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def key_digest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows of each group and an order-free digest of their keys: equal sets of keys give equal digests, in whatever order rows stand."""
    h = F.xxhash64(*[F.col(k).cast("string") for k in keys])
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("mixed"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The data files under a path: name, bytes and rows of each. Only the files' metadata are read."""
    return spark.read.parquet(path).select("_metadata").groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


#: What stands before a path: its file system.
_SCHEME = r"^[a-z0-9]+:(//[^/]*)?"


def _bare(path: str) -> str:
    return re.sub(_SCHEME, "", path).rstrip("/")


def _schemas(spark: SparkSession, paths: dict[str, str]) -> dict[str, StructType]:
    """The schema of each path, from footers; several are asked for at a time."""
    with ThreadPool(16) as pool:
        return dict(zip(paths, pool.map(inheritable_thread_target(spark)(lambda p: spark.read.parquet(p).schema), paths.values()), strict=True))


def validate_dataset(spark: SparkSession, datasets: dict[str, str], references: dict[str, str], keys: list[str], required: list[str]) -> DataFrame:
    """unit, valid, reason, rows, reference_rows, missing_keys, extra_keys for every unit (a month's dataset by name) of either side.

    A unit's files lie in its folder. Units are compared by their schemas first (required columns, number, order, types), then by rows and the digest of
    their keys; keys are joined only where the digests differ. Reasons: missing, extra, schema: ..., keys, ok.
    """
    both = sorted(set(datasets) & set(references))
    own, want = _schemas(spark, {u: datasets[u] for u in both}), _schemas(spark, {u: references[u] for u in both})
    problems = {u: "; ".join(schema_problems(own[u], want[u], required)) for u in both}
    units = [(u, "missing" if u not in datasets else "extra" if u not in references else f"schema: {problems[u]}" if problems[u] else None) for u in sorted({*datasets, *references})]
    listed = spark.createDataFrame(units, "unit string, reason string")
    kind = lambda t: tuple(t[k].dataType if k in t.names else None for k in keys)
    able = [u for u in both if None not in kind(want[u]) and kind(own[u]) == kind(want[u])]

    def joined(paths: dict[str, str]) -> DataFrame:
        """unit and keys of all units, a scan for each set of key types."""
        parts = [spark.createDataFrame([], ", ".join(["unit string", *[f"{k} string" for k in keys]]))]
        for types in {kind(want[u]) for u in able}:
            some: dict[str, list[str]] = {}
            for u in able:
                if kind(want[u]) == types:
                    some.setdefault(_bare(paths[u]), []).append(u)
            rows = spark.read.schema(StructType([StructField(k, t) for k, t in zip(keys, types, strict=True)])).parquet(*[paths[us[0]] for us in some.values()])
            folder = F.regexp_replace(F.regexp_replace("_metadata.file_path", r"/[^/]*$", ""), _SCHEME, "")
            names = F.create_map(*[x for path, us in some.items() for x in (F.lit(path), F.array(*map(F.lit, us)))])
            parts.append(rows.select(F.explode(names[folder]).alias("unit"), *[F.col(k).cast("string").alias(k) for k in keys]))
        return reduce(DataFrame.unionByName, parts)

    mine, theirs = joined(datasets), joined(references)
    a, b = key_digest(mine, keys, ["unit"]), key_digest(theirs, keys, ["unit"])
    digests = a.join(b.select("unit", *[F.col(c).alias(f"_{c}") for c in ("rows", "mixed", "high", "low")]), "unit", "full")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rows", "mixed", "high", "low")])
    digests = digests.select("unit", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("_rows", F.lit(0)).alias("reference_rows"), same.alias("_same"))
    differ = digests.filter(~F.col("_same")).select("unit")
    left, right = mine.join(differ, "unit", "left_semi").distinct().withColumn("_a", F.lit(1)), theirs.join(differ, "unit", "left_semi").distinct().withColumn("_b", F.lit(1))
    odd = left.join(right, ["unit", *keys], "full").groupBy("unit").agg(F.count_if(F.col("_a").isNull()).alias("missing_keys"), F.count_if(F.col("_b").isNull()).alias("extra_keys"))
    out = listed.join(digests, "unit", "left").join(odd, "unit", "left")
    reason = F.coalesce("reason", F.when(F.col("_same") | F.col("_same").isNull(), "ok").otherwise("keys"))  # neither side has rows: ok
    return out.select("unit", (reason == "ok").alias("valid"), reason.alias("reason"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "reference_rows", "missing_keys", "extra_keys")])
