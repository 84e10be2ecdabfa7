"""Labels, rolling windows, feature screening, scores, portfolios and their turnover.

Panels have (entity, month_idx, ...); month_idx counts calendar months, and neighbours in time are found by month_idx +- 1,
never by row order. Portfolios carry a `series` key, so many strategies are one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank, clip, correlation

def _month():
    return W.partitionBy("month_idx")


TIERS = (0.13,) * 5 + (0.07,) * 5


def label_rank(df: DataFrame, target: str = "target") -> DataFrame:
    """Average-tie percent rank of the target in its month; NULL stays NULL."""
    return df.withColumn("label_rank", avg_rank(target, "month_idx") / F.count(target).over(_month()))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, a row for each column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage")) for c in columns])).alias("x")).select("x.*")


def rolling_windows(months: DataFrame, train: int = 36, valid: int = 12, test: int = 1, step: int = 1) -> DataFrame:
    """(window_id, month_idx, split) of all windows over the distinct months, a small table; too few months is an error."""
    seen = months.select("month_idx").distinct()
    size = train + valid + test
    n = seen.count()
    if n < size:
        raise ValueError(f"{n} months, but a window takes {size}")
    order = seen.withColumn("pos", F.row_number().over(W.orderBy("month_idx")) - 1)
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step)), F.least(F.floor(F.col("pos") / step), F.lit((n - size) // step))))
    order = order.filter(F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step)) <= F.least(F.floor(F.col("pos") / step), F.lit((n - size) // step)))
    out = order.withColumn("window_id", starts).withColumn("off", F.col("pos") - F.col("window_id") * step)
    split = F.when(F.col("off") < train, "train").when(F.col("off") < train + valid, "valid").otherwise("test")
    return out.select(F.col("window_id").cast("long").alias("window_id"), "month_idx", split.alias("split"))


def window_stats(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows, months, first and last month of each window and split, from counts by month: rows aren't copied into windows."""
    sizes = df.groupBy("month_idx").agg(F.count("*").alias("rows"))
    return windows.join(sizes, "month_idx").groupBy("window_id", "split").agg(F.sum("rows").alias("rows"), F.count("*").alias("months"), F.min("month_idx").alias("first"), F.max("month_idx").alias("last"))


def candidate_features(df: DataFrame, drop_short: bool = False) -> list[str]:
    meta = {"entity", "month_idx", "pred_month", "industry", "industry_l1", "market_cap", "close", "target", "label_rank"}
    out = [c for c in df.columns if c not in meta and not c.endswith("_raw")]
    return [c for c in out if not any(x in c for x in ("_5d", "_10d", "_1w"))] if drop_short else out


def screen(df: DataFrame, features: list[str], label: str = "target") -> DataFrame:
    """Coverage, sample variance test and absolute correlation with the label (missing values as 0), a row for each feature; one pass."""
    rows = df.filter(F.col(label).isNotNull())
    one = rows.agg(*[x for c in features for x in (F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}|coverage"), F.stddev_samp(c).alias(f"{c}|std"), F.abs(correlation(F.coalesce(F.col(c), F.lit(0.0)), F.col(label))).alias(f"{c}|ic"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}|coverage`").alias("coverage"), F.col(f"`{c}|std`").alias("std"), F.col(f"`{c}|ic`").alias("ic")) for c in features])).alias("x")).select("x.*")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of all pairs of features with missing values as 0: a row for each pair."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    one = df.agg(*[correlation(zero(a), zero(b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def blend(df: DataFrame, weight: float) -> DataFrame:
    """score = w a + (1 - w) b and score_cv = population std of the pair / (|score| + 1e-6)."""
    df = df.withColumn("score", weight * F.col("score_a") + (1 - weight) * F.col("score_b"))
    return df.withColumn("score_cv", F.abs(F.col("score_a") - F.col("score_b")) / 2 / (F.abs("score") + 1e-6))


def build_portfolio(df: DataFrame, top: int = 20, weights: tuple[float, ...] = TIERS, least: int = 15, group: tuple[str, ...] = ("month_idx",)) -> DataFrame:
    """The best `top` rows of each cross-section of `least` rows or more, with tiers and weights; ties go by entity."""
    sizes = df.groupBy(*[F.col(c).alias(f"_g{c}") for c in group]).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    df = df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), "entity"))).filter(F.col("place") <= top)  # alone, so that each task keeps its best only
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in group])
    df = df.join(sizes, same, "left_semi")
    half = len(weights) // 2
    weight = F.coalesce(F.get(F.array(*[F.lit(w) for w in weights]), F.col("place") - 1), F.lit(0.0))
    tier = F.when(F.col("place") <= half, "High").when(F.col("place") <= len(weights), "Low").otherwise("Reserve")
    return df.withColumns({"tier": tier, "weight": weight, "is_holding": weight > 0})


def turnover(holdings: DataFrame, duty: float = 0.001, commission: float = 0.0003, slippage: float = 0.001) -> DataFrame:
    """Sells, buys, cost and rate of each series and month against the month before that exists; the first month is free."""
    months = holdings.select("series", "month_idx").distinct()
    following = months.withColumn("next_idx", F.lead("month_idx").over(W.partitionBy("series").orderBy("month_idx")))
    before = holdings.join(following.filter("next_idx is not null"), ["series", "month_idx"]).select("series", F.col("next_idx").alias("month_idx"), "entity", F.col("weight").alias("_old"))
    both = holdings.select("series", "month_idx", "entity", F.col("weight").alias("_new")).join(before, ["series", "month_idx", "entity"], "full")
    change = F.coalesce("_new", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))
    firsts = following.groupBy("series").agg(F.min("month_idx").alias("_first"))
    out = both.groupBy("series", "month_idx").agg(F.sum(F.greatest(-change, F.lit(0.0))).alias("sell"), F.sum(F.greatest(change, F.lit(0.0))).alias("buy")).join(firsts, "series")
    first = F.col("month_idx") == F.col("_first")
    cost = F.col("sell") * (duty + commission + slippage) + F.col("buy") * (commission + slippage)
    return out.select("series", "month_idx", *[F.when(first, 0.0).otherwise(x).alias(n) for n, x in (("sell", F.col("sell")), ("buy", F.col("buy")), ("cost", cost), ("rate", (F.col("sell") + F.col("buy")) / 2))])


def validation_returns(df: DataFrame, top: int = 10) -> DataFrame:
    """Mean return of the month's ten best validation scores, returns within +-30% and missing ones 0."""
    place = F.row_number().over(_month().orderBy(F.desc("score"), "entity"))
    return df.withColumn("_p", place).filter(F.col("_p") <= top).groupBy("month_idx").agg(F.avg(clip(F.coalesce("target", F.lit(0.0)), -0.3, 0.3)).alias("ret"))


def stitch(series: DataFrame) -> DataFrame:
    """For months that several windows cover, the value of the last window."""
    return series.groupBy("month_idx").agg(F.max("window_id").alias("window_id"), F.max_by("ret", "window_id").alias("ret"))


def contribution_summary(contrib: DataFrame, top: int = 5, share: float = 0.3) -> DataFrame:
    """Factors by mean over months of the monthly mean absolute contribution, if in enough months."""
    n = contrib.select("month_idx").distinct().count()
    monthly = contrib.groupBy("factor", "month_idx").agg(F.avg(F.abs("value")).alias("size"), F.avg("value").alias("signed"))
    out = monthly.groupBy("factor").agg(F.avg("size").alias("mean_abs"), F.avg("signed").alias("mean_signed"), F.count("*").alias("months"))
    return out.filter(F.col("months") >= max(3, share * n)).withColumn("place", F.row_number().over(W.orderBy(F.desc("mean_abs"), "factor"))).filter(F.col("place") <= top)


def contribution_by_month(contrib: DataFrame, top: int = 5) -> DataFrame:
    """Each month's factors by mean absolute contribution, the first `top`."""
    monthly = contrib.groupBy("month_idx", "factor").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"))
    place = F.row_number().over(W.partitionBy("month_idx").orderBy(F.desc("mean_abs"), "factor"))
    return monthly.withColumn("place", place).filter(F.col("place") <= top)


def contribution_correlation(contrib: DataFrame, top: int = 5) -> DataFrame:
    """Correlation over months of the mean signed contributions of the overall first factors, a missing month counting 0; all ordered pairs, `top` squared rows."""
    names = sorted(r.factor for r in contribution_summary(contrib, top).select("factor").collect())  # top rows
    wide = contrib.groupBy("month_idx").pivot("factor", names).agg(F.avg("value")).fillna(0.0, names)
    pairs = [(a, b) for a in names for b in names]
    one = wide.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("factor"), F.lit(b).alias("other"), F.nanvl(F.col(f"c{i}"), F.lit(None)).alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
