"""The validation portfolio of scored months, net of its costs, and the measures that trials are judged by."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank, clip, correlation

from . import portfolio

RF, SQRT12 = 0.03 / 12, math.sqrt(12)
#: Months from which there are measures at all, from which captures and regressions, and up and down months for captures.
LEAST, YEAR, EACH_WAY = 6, 12, 3


def portfolio_months(scored: DataFrame, cap: float = 0.3) -> DataFrame:
    """series, month_idx, gross, cost, rate, net_return of the ten best scores of each month, weighted by tier; returns within +-cap, missing ones 0; the first month costs nothing.

    scored: series, month_idx, entity, score, target. Ties go by entity.
    """
    place = F.row_number().over(W.partitionBy("series", "month_idx").orderBy(F.desc("score"), "entity"))
    weights = F.array(*[F.lit(w) for w in portfolio.TIERS])
    held = scored.withColumn("_p", place).filter(F.col("_p") <= len(portfolio.TIERS)).withColumn("weight", F.get(weights, F.col("_p") - 1))
    gross = held.groupBy("series", "month_idx").agg(F.sum(F.col("weight") * clip(F.coalesce("target", F.lit(0.0)), -cap, cap)).alias("gross"))
    out = gross.join(portfolio.turnover(held).select("series", "month_idx", "cost", "rate"), ["series", "month_idx"], "left")
    return out.withColumn("net_return", F.col("gross") - F.col("cost"))


def score_ics(scored: DataFrame, least: int = 10) -> DataFrame:
    """series, month_idx, ic: rank correlation of score and label_rank in months of `least` complete rows or more."""
    rows = scored.filter("score is not null and label_rank is not null")
    rows = rows.withColumns({"_a": avg_rank("score", "series", "month_idx"), "_b": avg_rank("label_rank", "series", "month_idx")})
    return rows.groupBy("series", "month_idx").agg(F.count("*").alias("_n"), F.coalesce(correlation("_a", "_b"), F.lit(0.0)).alias("ic")).filter(F.col("_n") >= least).drop("_n")


def _six(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns over frames of six months, NULL where the frame isn't full."""
    full = F.count("*").over(W.partitionBy("series").orderBy("month_idx").rowsBetween(-5, 0)) == LEAST
    return df.withColumns({k: F.when(full, c) for k, c in columns.items()})


def measures(months: DataFrame, ics: DataFrame) -> DataFrame:
    """One row a series of (net_return, benchmark_return, rate); under six months all measures are 0.

    Deviations are sample ones. The worst quartile is the lowest quarter of months (one at least) by excess.
    """
    order = W.partitionBy("series").orderBy("month_idx")
    six = order.rowsBetween(-5, 0)
    df = months.withColumns({"r": F.col("net_return"), "b": F.col("benchmark_return"), "ex": F.col("net_return") - F.col("benchmark_return")})
    low, down = F.when(F.col("ex") < 0, F.col("ex")), F.when(F.col("r") < RF, F.col("r"))
    std = lambda c: F.stddev_samp(c).over(six)
    mean = lambda c: F.avg(c).over(six)
    spread = lambda c, whole, least: F.greatest(F.when(F.count(c).over(six) > 1, F.stddev_samp(c).over(six)).otherwise(whole), F.lit(least))
    df = _six(df, {
        "ir6": F.when(std("ex") > 1e-8, mean("ex") / std("ex") * SQRT12).otherwise(0.0), "dir6": mean("ex") / spread(low, std("ex"), 1e-8) * SQRT12,
        "sortino6": (mean("r") - RF) / spread(down, std("r"), 1e-6) * SQRT12, "return6": F.product(1 + F.col("r")).over(six) - 1, "excess6": mean("ex"),
    })
    df = df.withColumn("cum", F.product(1 + F.col("r")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("series")
    df = df.withColumns({
        "drawdown": F.col("cum") / F.max("cum").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1, "var": F.percentile("r", 0.05).over(whole),
        "_place": F.row_number().over(W.partitionBy("series").orderBy("ex", "month_idx")), "_n": F.count("*").over(whole),
    })
    worst = F.when(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 4)), F.col("ex"))
    up, dn = F.col("b") > 0, F.col("b") < 0
    over = lambda test, c: F.avg(F.when(test, F.col(c)))
    y, x = F.col("r") - RF, F.col("b") - RF
    g = df.groupBy("series").agg(
        F.count("*").alias("n"), F.avg("ir6").alias("val_rolling6m_ir"), F.avg("dir6").alias("val_rolling6m_dir"), F.avg("sortino6").alias("val_rolling6m_sortino"), F.avg("return6").alias("val_rolling6m_return"),
        F.stddev_samp("ir6").alias("val_ir_stability"), F.avg("excess6").alias("val_rolling6m_excess"), F.avg("ex").alias("_mean"), F.stddev_samp("ex").alias("_std"), F.product(1 + F.col("r")).alias("_growth"),
        F.avg((F.col("ex") > 0).cast("double")).alias("pct_positive_excess"), F.avg(worst).alias("_worst"), F.stddev_samp(worst).alias("_worst_std"), F.avg("rate").alias("turnover_penalty"),
        F.count_if(up).alias("_ups"), F.count_if(dn).alias("_downs"), (over(up, "r") / over(up, "b")).alias("_up"), (over(dn, "r") / over(dn, "b")).alias("_down"),
        F.regr_slope(y, x).alias("_beta"), F.regr_intercept(y, x).alias("_alpha"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.max("var").alias("val_var_95"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("val_cvar_95"), F.avg(F.abs("drawdown")).alias("val_pain_index"), F.avg("r").alias("_r"), F.stddev_samp("r").alias("_rs"),
    )
    smooth = _six(ics, {"ic6": F.avg("ic").over(six)}).groupBy("series").agg(F.stddev_samp("ic6").alias("val_ic_stability"))
    g = g.join(smooth, "series", "left")
    n, long = F.col("n"), F.col("n") >= YEAR
    capture = long & (F.col("_ups") >= EACH_WAY) & (F.col("_downs") >= EACH_WAY)
    left = F.sqrt(F.greatest(F.col("_syy") - F.col("_beta") * F.col("_sxy"), F.lit(0.0)) / (n - 1))
    found = {
        **{c: F.col(c) for c in ("val_rolling6m_ir", "val_rolling6m_dir", "val_rolling6m_sortino", "val_rolling6m_return", "val_rolling6m_excess", "val_ir_stability", "val_ic_stability", "pct_positive_excess", "turnover_penalty", "val_var_95", "val_cvar_95", "val_pain_index")},
        "val_rolling6m_excess_ann": F.col("val_rolling6m_excess") * 12, "val_global_ir": F.when(F.col("_std") > 1e-8, F.col("_mean") / F.col("_std") * SQRT12), "val_annual_return": F.pow(F.col("_growth"), 12 / n) - 1,
        "ir_worst_quartile": clip(F.col("_worst") / F.greatest(F.coalesce("_worst_std", F.lit(1e-8)), F.lit(1e-8)), -5.0, 5.0),
        "up_capture_ratio": F.when(capture, F.round("_up", 4)), "down_capture_ratio": F.when(capture, F.round("_down", 4)), "capture_ratio": F.when(capture & (F.abs("_down") >= 1e-6), F.round(F.col("_up") / F.col("_down"), 4)),
        "val_jensen_alpha": F.when(long, F.col("_alpha") * 12), "val_beta": F.when(long, F.col("_beta")), "val_appraisal_ratio": F.when(long & (left > 1e-8), F.col("_alpha") / left),
        "val_sqn": F.when(F.col("_rs") > 1e-8, F.col("_r") / F.col("_rs") * F.sqrt(n)),
    }
    return g.select("series", n.alias("months"), *[F.when(n >= LEAST, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(k) for k, c in found.items()])


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag of each series with the greatest absolute correlation (ties: the least), and that correlation."""
    key = F.struct(F.abs("r").alias("a"), (-F.abs("lag")).alias("near"), (-F.col("lag")).alias("lag"))
    return correlations.filter("r is not null").groupBy("series").agg(F.max_by("lag", key).alias("best_lag"), F.max_by("r", key).alias("r"))


def tier_curves(returns: DataFrame) -> DataFrame:
    """Growth and drawdown of each tier along its months."""
    upto = W.partitionBy("series", "tier").orderBy("month_idx").rowsBetween(W.unboundedPreceding, 0)
    df = returns.withColumn("cum", F.product(1 + F.col("ret")).over(upto))
    return df.withColumn("drawdown", F.col("cum") / F.max("cum").over(upto) - 1)


def adjusted_return(now: DataFrame, adjustments: DataFrame, cap: float = 0.5) -> DataFrame:
    """entity, month_idx, target: return to the next calendar month from prices times their adjustment, within +-cap.

    now: entity, month_idx, close; adjustments: entity, month_idx, adj. A month in which any entity has both adjustments
    takes only such entities; one in which none has falls back to plain prices.
    """
    df = now.join(adjustments, ["entity", "month_idx"], "left")
    after = df.select("entity", (F.col("month_idx") - 1).alias("month_idx"), F.col("close").alias("_close"), F.col("adj").alias("_adj"))
    df = df.join(after, ["entity", "month_idx"], "left")
    both = F.col("_close").isNotNull() & F.col("adj").isNotNull() & F.col("_adj").isNotNull()
    some = F.bool_or(both).over(W.partitionBy("month_idx"))
    adjusted, plain = F.col("_close") * F.col("_adj") / (F.col("close") * F.col("adj")) - 1, F.col("_close") / F.col("close") - 1
    return df.select("entity", "month_idx", clip(F.when(some, F.when(both, adjusted)).otherwise(plain), -cap, cap).alias("target"))


def top_contributions(rows: DataFrame, given: DataFrame | None, places: int = 3) -> DataFrame:
    """month_idx, factor, value: the given contributions, or where there are none (None or an empty table) the named places top1_factor, top1_value, ... of the rows."""
    named = rows.select("month_idx", F.explode(F.array(*[F.struct(F.col(f"top{i}_factor").alias("factor"), F.col(f"top{i}_value").alias("value")) for i in range(1, places + 1)])).alias("t")).select("month_idx", "t.*").filter("factor is not null and value is not null")
    return named if given is None or given.isEmpty() else given.select("month_idx", "factor", "value")
