"""Joins and checks that line tables up: keys, months, look-ahead, backfills, return vectors, overlay returns, advice on trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_intersection(*tables: DataFrame, key: str = "entity") -> DataFrame:
    """Keys that all tables have."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t, key, "left_semi")
    return out


def month_alignment(a: DataFrame, b: DataFrame, month: str = "month_idx") -> DataFrame:
    """Months of either table and the sides that have them."""
    left, right = (t.select(month).distinct().withColumn(side, F.lit(True)) for t, side in ((a, "in_a"), (b, "in_b")))
    return left.join(right, month, "full").fillna(False, ["in_a", "in_b"])


def lookahead_violations(holdings: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows whose factor date is after the holding date, counted by month; none may remain before the overlay runs."""
    both = holdings.join(factors, ["entity", "month_idx"])
    return both.groupBy("month_idx").agg(F.count("*").alias("pairs"), F.count_if(F.col("factor_date") > F.col("holding_date")).alias("violations"))


def require_no_lookahead(rows: DataFrame, factor_date: str = "factor_date", holding_date: str = "holding_date") -> DataFrame:
    """rows as they are; the job fails where a factor's date is after the holding's. The test is part of the column, so it can't be planned away while the column is used."""
    late = F.concat(F.lit("factor of "), F.col(factor_date).cast("string"), F.lit(" used on "), F.col(holding_date).cast("string"))
    return rows.withColumn(factor_date, F.when(F.col(factor_date) > F.col(holding_date), F.raise_error(late)).otherwise(F.col(factor_date)))


def require_months(rows: DataFrame, month: str = "pred_month") -> DataFrame:
    """rows as they are; the job fails where a month isn't six digits of a real month."""
    ok = F.coalesce(F.col(month).cast("string").rlike(r"^\d{4}(0[1-9]|1[0-2])$"), F.lit(False))
    return rows.withColumn(month, F.when(ok, F.col(month)).otherwise(F.raise_error(F.concat(F.lit("not a month: "), F.coalesce(F.col(month).cast("string"), F.lit("NULL"))))))


def join_new_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right that it lacks, by key; a key that right has several times is an error of the caller."""
    return left.join(right.select(*keys, *[F.col(f"`{c}`") for c in right.columns if c not in left.columns]), keys, "left")


def backfill(holdings: DataFrame, by_date: DataFrame, by_slice: DataFrame) -> DataFrame:
    """Missing targets from a table of returns by date, then from the prediction slice."""
    keys = ["entity", "month_idx"]
    df = holdings.join(by_date.select(*keys, F.col("target").alias("_first")), keys, "left").join(by_slice.select(*keys, F.col("target").alias("_second")), keys, "left")
    return df.withColumn("target", F.coalesce("target", "_first", "_second")).drop("_first", "_second")


def returns_matrix(bars: DataFrame, n: int = 60) -> DataFrame:
    """For the entity's latest bar, its n latest log returns, newest first; NULL as a whole if a price isn't positive or there are too few bars."""
    by = W.partitionBy("entity")
    df = bars.withColumn("age", F.row_number().over(by.orderBy(F.desc("date"))) - 1).filter(F.col("age") <= n)
    df = df.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("age", "close"))), lambda x: x["close"]).alias("c"))
    c = F.col("c")
    ok = (F.size(c) == n + 1) & F.forall(c, lambda x: x > 0)
    return df.select("entity", F.when(ok, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.log(F.get(c, i) / F.get(c, i + 1)))).alias("returns"))


def overlay_returns(done: DataFrame, targets: DataFrame, rf_annual: float = 0.025) -> DataFrame:
    """Return of each processed month with sold weights in cash: sum w (1 + r) + cash (1 + rf) - sum of weights."""
    r = F.when(F.col("sold"), F.lit(rf_annual / 12)).otherwise(F.coalesce("target", F.lit(0.0)))
    return done.join(targets, ["entity", "seq"], "left").groupBy("seq").agg(F.sum(F.col("weight") * r).alias("ret"), F.sum(F.when(F.col("sold"), F.col("weight")).otherwise(0.0)).alias("cash"))


def extremes(curve: DataFrame, k: int = 5) -> DataFrame:
    """The k highest and lowest months of each series: a top-k report."""
    by = W.partitionBy("series")
    df = curve.withColumns({"high": F.row_number().over(by.orderBy(F.desc("cum"), "month_idx")), "low": F.row_number().over(by.orderBy("cum", "month_idx"))})
    return df.filter((F.col("high") <= k) | (F.col("low") <= k)).select("series", "month_idx", "cum", "high", "low")


def ic_gap(ics: DataFrame, windows: DataFrame, limit: float = 0.15) -> DataFrame:
    """For each rolling window and factor: IC of the last training month, less the mean validation IC, and the confidence that follows."""
    in_window = ics.join(windows, "month_idx").groupBy("window_id", "factor")
    train, valid = F.col("split") == "train", F.col("split") == "valid"
    df = in_window.agg(F.max_by(F.when(train, F.col("ic")), F.when(train, F.col("month_idx"))).alias("train_ic"), F.avg(F.when(valid, F.col("ic"))).alias("val_ic"), F.count_if(train).alias("_n"), F.count_if(valid).alias("_v"))
    df = df.filter("_n > 0 and _v > 0").drop("_n", "_v").withColumn("gap", F.col("train_ic") - F.col("val_ic"))
    return df.withColumn("confidence", F.when(F.col("gap") > limit, "LOW").otherwise("OK"))


def range_advice(convergence: DataFrame, k: float = 2.0) -> DataFrame:
    """Fix a parameter whose deviation is under 0.15 of its mean, else search mean +- k deviations."""
    cv = F.col("top_std") / F.abs("top_mean")
    df = convergence.withColumn("advice", F.when(cv < 0.15, "fix").otherwise("search"))
    return df.select("param", "advice", (F.col("top_mean") - k * F.col("top_std")).alias("low"), (F.col("top_mean") + k * F.col("top_std")).alias("high"))
