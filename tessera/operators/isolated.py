"""Parts of a report that run on their own: one that fails leaves a status row, and the others their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.streaming.feeds import scratch


def run_all(spark: SparkSession, parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Status rows (part, status ok, empty or failed, rows, error) and the results of those that didn't fail, written once and read from there.

    A part may fail when it is planned or when its rows are made; either way the others run.
    """
    status, results = [], {}
    for name, part in parts.items():
        at = f"{scratch(spark)}/{name}"
        try:
            df = part()
            df.write.parquet(at)
            results[name] = spark.read.schema(df.schema).parquet(at)
            n = results[name].count()
            status.append((name, "ok" if n else "empty", n, None))
        except Exception as error:  # whatever it is, it is this part's
            results.pop(name, None)
            status.append((name, "failed", 0, str(error).strip().split("\n")[0][:500]))
    return spark.createDataFrame(status, "part string, status string, rows long, error string"), results
