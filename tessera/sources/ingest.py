"""Ingest: calendars, universe filters, point-in-time joins, price adjustment, schema alignment, validation, incremental months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def month_list(spark: SparkSession, start: str, end: str) -> DataFrame:
    """YYYYMM from start to end, both included."""
    months = F.sequence(F.to_date(F.lit(start + "01"), "yyyyMMdd"), F.to_date(F.lit(end + "01"), "yyyyMMdd"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.date_format("m", "yyyyMM").alias("month"))


def month_end_days(calendar: DataFrame) -> DataFrame:
    """The last day of each month that the calendar has."""
    return calendar.groupBy(F.date_format("date", "yyyyMM").alias("month")).agg(F.max("date").alias("last_day"))


def report_period(date: Column) -> Column:
    """The quarter whose statement is used in a month."""
    m, y = F.month(date), F.year(date)
    return F.when(m <= 3, F.format_string("%04d1231", y - 1)).when(m <= 6, F.format_string("%04d0331", y)).when(m <= 9, F.format_string("%04d0630", y)).otherwise(F.format_string("%04d0930", y))


def universe_rules(low_days: int, turnover: tuple[float, float], cap: tuple[float, float], least_price: float, most_suspended: int | None = None) -> dict[str, Column]:
    """Rules of the universe; a missing number fails its rule, a missing name passes. most_suspended adds the rule on suspend_days."""
    suspended = {} if most_suspended is None else {"suspended": F.col("suspend_days") <= most_suspended}
    return suspended | {
        "name": F.coalesce(~F.col("name").rlike("ST|PT"), F.lit(True)), "days_listed": F.col("days_listed") >= low_days,
        "turnover": F.col("turnover").between(*turnover), "market_cap": F.col("market_cap").between(*cap), "price": F.col("close") >= least_price,
    }


def filter_universe(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(False))
    return df.filter(ok)


def reject_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that each rule rejects, in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("rejected")) for k in rules])).alias("x")).select("x.*")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, known: str) -> DataFrame:
    """left with, as `value`, the right row of its key that was last known at its date: a grouped max_by, no range join.

    Both sides become events of their key, ordered by time; each left row takes the last right value before it.
    """
    events = left.select(key, F.col(at).alias("_t"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("double").alias("_v"))
    events = events.unionByName(right.select(key, F.col(known).alias("_t"), F.lit(0).alias("_left"), F.col("value").cast("double").alias("_v")), allowMissingColumns=True)
    upto = W.partitionBy(key).orderBy("_t", "_left", "_v").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("value", F.last("_v", ignorenulls=True).over(upto)).filter("_left = 1").select("_row.*", "value")


def adjust_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times the day's factor over the entity's latest; as they are where there is no factor."""
    latest = factors.groupBy("entity").agg(F.max_by("adj", "date").alias("_latest"))
    df = bars.join(factors, ["entity", "date"], "left").join(latest, "entity", "left")
    scale = F.coalesce(F.col("adj") / F.col("_latest"), F.lit(1.0))
    return df.withColumns({c: F.col(c) * scale for c in ("open", "high", "low", "close")}).drop("adj", "_latest")


def recent_bars(bars: DataFrame, last: int = 300, least: int = 60) -> DataFrame:
    """The latest bars of each entity that has enough, newest first by `age`."""
    by = W.partitionBy("entity")
    df = bars.withColumn("age", F.row_number().over(by.orderBy(F.desc("date"))) - 1).withColumn("_n", F.count("*").over(by))
    return df.filter((F.col("age") < last) & (F.col("_n") >= least)).drop("_n")


def bars_from_events(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars of each user from event values; the same code runs on a stream (with a watermark) and on a table."""
    key = F.struct("ts", "event_id")
    g = events.groupBy(F.window("ts", width), "user_id").agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("n"))
    return g.select("user_id", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def align_schema(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns in the reference's order, missing ones NULL, extra ones last."""
    own = set(df.columns)
    first = [F.col(f"`{f.name}`") if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in reference.schema.fields]
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in reference.columns])


def fill_cells(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """df in the reference's column order; its missing columns and NULL cells come from the reference's row of the same keys (one at most), extra columns last."""
    other = reference.select(*keys, *[F.col(f"`{c}`").alias(f"_ref_{i}") for i, c in enumerate(reference.columns) if c not in keys])
    ref = {c: F.col(f"_ref_{i}") for i, c in enumerate(reference.columns) if c not in keys}
    cells = [F.col(f"`{c}`") if c in keys else (F.coalesce(F.col(f"`{c}`"), ref[c]) if c in df.columns else ref[c]).alias(c) for c in reference.columns]
    return df.join(other, keys, "left").select(*cells, *[F.col(f"`{c}`") for c in df.columns if c not in reference.columns])


def schema_problems(df: DataFrame | StructType, reference: DataFrame | StructType, required: list[str]) -> list[str]:
    """What is wrong with the columns of a table or schema: required ones that are absent, their number, their order, their types; read from the schemas alone."""
    df, reference = (t if isinstance(t, StructType) else t.schema for t in (df, reference))
    own, want = ({f.name: f.dataType.simpleString() for f in t.fields} for t in (df, reference))
    out = [f"absent: {c}" for c in required if c not in own]
    if len(own) != len(want):
        out.append(f"columns: {len(own)}, not {len(want)}")
    common = [c for c in df.names if c in want]
    if common != [c for c in reference.names if c in own]:
        out.append("order")
    return out + [f"type of {c}: {own[c]}, not {want[c]}" for c in common if own[c] != want[c]]


def validate_months(df: DataFrame, reference: DataFrame, key: str = "entity", month: str = "month_idx") -> DataFrame:
    """Rows of each month on both sides, keys on one side only, and whether the month is valid."""
    a, b = df.select(month, key, F.lit(1).alias("_a")), reference.select(month, key, F.lit(1).alias("_b"))
    g = a.join(b, [month, key], "full").groupBy(month).agg(F.count("_a").alias("rows"), F.count("_b").alias("reference_rows"), F.count_if(F.col("_b").isNull()).alias("extra_keys"), F.count_if(F.col("_a").isNull()).alias("missing_keys"))
    return g.withColumn("valid", (F.col("extra_keys") == 0) & (F.col("missing_keys") == 0))


def incremental_months(source: DataFrame, target: DataFrame, month: str = "month_idx", force: bool = False) -> DataFrame:
    """Months of the source that the target hasn't."""
    months = source.select(month).distinct()
    return months if force else months.join(target.select(month).distinct(), month, "left_anti")


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet by scheme and month; only the partitions present in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scheme", "month").parquet(path)
