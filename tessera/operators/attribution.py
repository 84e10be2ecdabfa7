"""Attribution of portfolio returns: Brinson effects, factor spreads and regressions, style exposures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.streaming.feeds import written

CASH = ("CASH", "CASH_POOL")


def industry_universe(df: DataFrame) -> DataFrame:
    """Each industry's share of the month's rows."""
    n = df.groupBy("month_idx", "industry").agg(F.count("*").alias("_n"))
    return n.withColumn("w_benchmark", F.col("_n") / F.sum("_n").over(W.partitionBy("month_idx"))).drop("_n")


def brinson(holdings: DataFrame, universe: DataFrame) -> DataFrame:
    """Allocation, selection and interaction of every industry held; the benchmark is the universe, equally weighted.

    Cash has no selection and no interaction, and its missing returns are 0. In a month that the universe lacks, the
    industries held share the benchmark's weight evenly.
    """
    cash = F.upper("industry").isin(*CASH)
    ret = F.when(cash, F.coalesce("target", F.lit(0.0))).otherwise(F.col("target"))
    held = holdings.groupBy("series", "month_idx", "industry").agg(F.sum("weight").alias("w_port"), F.coalesce(F.sum(F.col("weight") * ret) / F.sum("weight"), F.lit(0.0)).alias("r_port"))
    by_industry = universe.filter("target is not null").groupBy("month_idx", "industry").agg(F.avg("target").alias("r_benchmark"))
    market = universe.filter("target is not null").groupBy("month_idx").agg(F.avg("target").alias("r_market"))
    df = held.join(industry_universe(universe), ["month_idx", "industry"], "left").join(by_industry, ["month_idx", "industry"], "left").join(market, "month_idx", "left")
    known = universe.select("month_idx").distinct().withColumn("_known", F.lit(True))
    even = F.when(F.col("_known").isNull(), 1 / F.count("*").over(W.partitionBy("series", "month_idx"))).otherwise(0.0)
    df = df.join(known, "month_idx", "left").withColumn("w_benchmark", F.coalesce("w_benchmark", even)).drop("_known").fillna(0.0, ["r_benchmark", "r_market"])
    over, better = F.col("w_port") - F.col("w_benchmark"), F.col("r_port") - F.col("r_benchmark")
    return df.withColumns({
        "allocation": over * (F.col("r_benchmark") - F.col("r_market")),
        "selection": F.when(cash, 0.0).otherwise(F.col("w_benchmark") * better),
        "interaction": F.when(cash, 0.0).otherwise(over * better),
    })


def overlaid(positions: DataFrame, universe: DataFrame, series: str = "overlay") -> DataFrame:
    """Holdings to attribute from the overlay's positions (`selection.with_cash`): industries and targets by entity and month, freed weight as an industry of its own that earns the risk-free rate."""
    cash = F.col("entity") == CASH[1]
    at = universe.select(F.col("entity").cast("string").alias("entity"), F.col("month_idx").cast("int").alias("seq"), "industry", "target")
    df = positions.filter(~cash).join(at, ["entity", "seq"]).select("seq", "industry", "weight", "target")
    freed = positions.filter(cash).select("seq", F.col("entity").alias("industry"), "weight", F.col("ret").alias("target"))
    return df.unionByName(freed).select(F.lit(series).alias("series"), F.col("seq").alias("month_idx"), "industry", "weight", "target")


def brinson_rollup(effects: DataFrame) -> DataFrame:
    """Effects summed by month, by industry, and in all, in one pass over grouping sets."""
    sets = [["series", "month_idx"], ["series", "industry"], ["series"]]
    return effects.groupingSets([[F.col(c) for c in x] for x in sets], "series", "month_idx", "industry").agg(*[F.sum(c).alias(c) for c in ("allocation", "selection", "interaction")])


def proxy_factors(df: DataFrame, columns: dict[str, tuple[str, bool]], rf_annual: float = 0.03, least: int = 30) -> DataFrame:
    """Monthly factor returns: the market over the risk-free rate, and for each name the mean target at or below the median of a column less that above (or the reverse if `high`); months under `least` rows give 0."""
    df = df.filter("target is not null")
    medians = df.groupBy("month_idx").agg(*[F.median(c).alias(f"_m_{k}") for k, (c, _) in columns.items()])
    df = df.join(F.broadcast(written(medians)), "month_idx")  # a row a month
    aggs = [(F.avg("target") - rf_annual / 12).alias("mkt")]
    for k, (c, high) in columns.items():
        low = F.avg(F.when(F.col(c) <= F.col(f"_m_{k}"), F.col("target")))
        up = F.avg(F.when(F.col(c) > F.col(f"_m_{k}"), F.col("target")))
        aggs.append(F.coalesce(up - low if high else low - up, F.lit(0.0)).alias(k))
    out = df.groupBy("month_idx").agg(F.count("*").alias("_n"), *aggs)
    return out.select("month_idx", *[F.when(F.col("_n") >= least, F.col(k)).otherwise(0.0).alias(k) for k in ("mkt", *columns)])


def factor_regression(df: DataFrame, factors: list[str], ridge: float = 0.01, least: int = 6) -> DataFrame:
    """Expanding-window ridge of `excess` on the factors, intercept penalised too: running sums by Spark, a small solve for each row.

    Rows before `least` months give zeros; alpha is annual; r2 is of the months so far.
    """
    order = W.partitionBy("series").orderBy("month_idx").rowsBetween(W.unboundedPreceding, 0)
    terms = ["_one", *factors]
    df = df.withColumn("_one", F.lit(1.0))
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col(terms[i]) * F.col(terms[j])).over(order) for i, j in pairs] + [F.sum(F.col(t) * F.col("excess")).over(order) for t in terms] + [F.sum(F.col("excess") ** 2).over(order)]
    df = df.withColumn("_n", F.count("*").over(order)).withColumn("_g", F.array(*sums))

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for rows, x in zip(n, g, strict=True):
            if rows < least:
                out.append([0.0] * (k + 1))
                continue
            x = np.asarray(x, float)
            a = np.zeros((k, k))
            for (i, j), v in zip(pairs, x, strict=False):
                a[i, j] = a[j, i] = v
            b, yy = x[len(pairs) : -1], x[-1]
            beta = np.linalg.solve(a + ridge * np.eye(k), b)
            rss = yy - 2 * beta @ b + beta @ a @ beta
            tss = yy - b[0] ** 2 / rows
            out.append([*beta.tolist(), 1 - rss / tss if tss > 1e-12 else 0.0])
        return pd.Series(out)

    df = df.withColumn("_b", solve("_n", "_g"))
    return df.select("series", "month_idx", (F.col("_b")[0] * 12).alias("alpha"), *[F.col("_b")[i + 1].alias(f"beta_{f}") for i, f in enumerate(factors)], F.col("_b")[k].alias("r2"))


def exposures(holdings: DataFrame, spreads: DataFrame, styles: list[str]) -> DataFrame:
    """Weighted style exposure of each portfolio (missing values 0) and its part of the return, exposure times the style's quantile spread."""
    long = holdings.select("series", "month_idx", "weight", F.explode(F.array(*[F.struct(F.lit(s).alias("factor"), F.coalesce(F.col(s), F.lit(0.0)).alias("x")) for s in styles])).alias("z")).select("series", "month_idx", "weight", "z.*")
    out = long.groupBy("series", "month_idx", "factor").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("exposure"))
    return out.join(spreads, ["month_idx", "factor"], "left").withColumn("contribution", F.col("exposure") * F.coalesce("spread", F.lit(0.0)))
