"""Performance of monthly return series, keyed by `series`: one row of measures each, any number of series in one job."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import correlation

def _order():
    return W.partitionBy("series").orderBy("month_idx")


def _all():
    return W.partitionBy("series")


SQRT12 = math.sqrt(12)


def benchmark_returns(closes: DataFrame) -> DataFrame:
    """Return of each month's close to that of the next month that exists."""
    return closes.withColumn("benchmark_return", F.lead("close").over(W.orderBy("month_idx")) / F.col("close") - 1).select("month_idx", "benchmark_return")


def monthly_returns(holdings: DataFrame, benchmark: DataFrame, costs: DataFrame) -> DataFrame:
    """Sum of weight * return of each series and month (missing returns dropped, weights as they are), benchmark, excess, cost, net."""
    held = holdings.filter("is_holding and target is not null").groupBy("series", "month_idx").agg(F.sum(F.col("weight") * F.col("target")).alias("portfolio_return"))
    out = held.join(benchmark, "month_idx", "left")
    out = out.join(costs.select("series", "month_idx", F.col("cost").alias("turnover_cost")), ["series", "month_idx"], "left")
    out = out.withColumns({"benchmark_return": F.coalesce("benchmark_return", F.lit(0.0)), "turnover_cost": F.coalesce("turnover_cost", F.lit(0.0))})
    return out.withColumns({"excess_return": F.col("portfolio_return") - F.col("benchmark_return"), "net_return": F.col("portfolio_return") - F.col("turnover_cost")})


def curves(monthly: DataFrame, ret: str = "portfolio_return") -> DataFrame:
    """Cumulative growth, drawdown from the running maximum of the curve, and the month's place in its series."""
    df = monthly.withColumn("n", F.row_number().over(_order())).withColumn("cum", F.product(1 + F.col(ret)).over(_order()))
    return df.withColumn("drawdown", F.col("cum") / F.max("cum").over(_order()) - 1)


def measures(monthly: DataFrame, rf_annual: float = 0.03, ret: str = "portfolio_return") -> DataFrame:
    """One row a series."""
    rf = rf_annual / 12
    df = curves(monthly, ret).withColumns({"r": F.col(ret), "bm": F.col("benchmark_return"), "ex": F.col("excess_return")})
    six = _order().rowsBetween(-5, 0)
    df = df.withColumns({
        "total": F.count("*").over(_all()), "var": F.percentile("r", 0.05).over(_all()),
        "ex6": F.when(F.count("*").over(six) == 6, F.sum("ex").over(six)), "m6": F.avg("ex").over(six), "s6": F.stddev_samp("ex").over(six),
        "block": F.floor((F.col("n") - 1) / 12),
    })
    df = df.withColumn("year_dd", F.when((F.col("n") % 12 == 0), F.min("drawdown").over(W.partitionBy("series", "block"))))
    df = df.withColumn("ir6", F.when(F.col("ex6").isNotNull(), F.when(F.col("s6") > 1e-8, F.col("m6") / F.col("s6") * SQRT12).otherwise(0.0)))
    down, up = F.when(F.col("r") < rf, F.col("r")), F.when(F.col("r") >= rf, F.col("r"))
    a = df.groupBy("series").agg(
        F.count("*").alias("months"), F.max_by("cum", "n").alias("cum"), F.product(1 + F.col("bm")).alias("cum_bm"), F.product(1 + F.col("net_return")).alias("cum_net"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.abs("drawdown")).alias("pain_index"), F.sqrt(F.avg(F.col("drawdown") ** 2)).alias("ulcer_index"),
        F.avg((F.col("ex") > 0).cast("double")).alias("monthly_win_rate"), (F.stddev_samp("r") * SQRT12).alias("volatility"),
        F.coalesce(F.stddev_samp(down) * SQRT12, F.lit(1e-6)).alias("downside_volatility"), F.coalesce(F.stddev_samp(up) * SQRT12, F.lit(1e-6)).alias("upside_volatility"),
        F.avg("ex").alias("mean_ex"), F.stddev_samp("ex").alias("std_ex"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("std_r"),
        F.first("var").alias("var_95"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar_95"), F.percentile("r", 0.95).alias("p95"),
        F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"),
        F.sum(F.when(F.col("r") > rf, F.col("r") - rf).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col("r") <= rf, rf - F.col("r")).otherwise(0.0)).alias("loss"),
        F.avg(F.when(F.col("bm") > 0, F.col("r"))).alias("r_up"), F.avg(F.when(F.col("bm") > 0, F.col("bm"))).alias("b_up"),
        F.avg(F.when(F.col("bm") < 0, F.col("r"))).alias("r_dn"), F.avg(F.when(F.col("bm") < 0, F.col("bm"))).alias("b_dn"),
        F.avg("year_dd").alias("year_dd"), F.sqrt(F.sum(F.col("year_dd") ** 2)).alias("year_dd2"),
        F.avg((F.col("ex6") > 0).cast("double")).alias("rolling6m_win_rate"), F.avg("ir6").alias("rolling6m_ir"), F.avg("turnover_cost").alias("avg_monthly_turnover_cost"),
        F.regr_slope(F.col("r") - rf, F.col("bm") - rf).alias("beta"), F.regr_intercept(F.col("r") - rf, F.col("bm") - rf).alias("alpha"),
        F.regr_syy(F.col("r") - rf, F.col("bm") - rf).alias("syy"), F.regr_sxy(F.col("r") - rf, F.col("bm") - rf).alias("sxy"),
    )
    yearly = lambda c: F.pow(c, 12 / F.col("months")) - 1
    over = lambda x, y: F.when(y > 1e-8, x / y).otherwise(0.0)
    a = a.withColumns({"cagr": yearly(F.col("cum")), "cagr_benchmark": yearly(F.col("cum_bm")), "net_cagr_after_cost": yearly(F.col("cum_net"))})
    full = F.col("months") >= 12
    capture_up = F.when(F.col("b_up").isNotNull(), F.col("r_up") / F.col("b_up")).otherwise(0.0)
    capture_dn = F.when(F.col("b_dn").isNotNull(), F.col("r_dn") / F.col("b_dn")).otherwise(0.0)
    resid = F.sqrt((F.col("syy") - F.col("beta") * F.col("sxy")) / (F.col("months") - 1))
    out = {
        "months": F.col("months"), "cagr": F.col("cagr"), "cagr_benchmark": F.col("cagr_benchmark"), "annual_excess": F.col("cagr") - F.col("cagr_benchmark"), "net_cagr_after_cost": F.col("net_cagr_after_cost"),
        "max_drawdown": F.col("max_drawdown"), "pain_index": F.col("pain_index"), "ulcer_index": F.col("ulcer_index"), "monthly_win_rate": F.col("monthly_win_rate"),
        "volatility": F.col("volatility"), "downside_volatility": F.col("downside_volatility"), "upside_volatility": F.col("upside_volatility"), "volatility_ratio": over(F.col("upside_volatility"), F.col("downside_volatility")),
        "sharpe": over(F.col("cagr") - rf_annual, F.col("volatility")), "sortino": over(F.col("cagr") - rf_annual, F.col("downside_volatility")), "calmar": over(F.col("cagr"), F.abs("max_drawdown")),
        "ir": over(F.col("mean_ex") * SQRT12, F.col("std_ex")), "var_95": F.col("var_95"), "cvar_95": F.col("cvar_95"), "skewness": F.col("skewness"), "kurtosis": F.col("kurtosis"),
        "omega": over(F.col("gain"), F.col("loss")), "tail": over(F.col("p95"), F.abs("var_95")), "up_capture": capture_up, "down_capture": capture_dn,
        "capture": F.when(F.abs(capture_dn) > 1e-8, capture_up / capture_dn).otherwise(0.0),
        "sterling": over(F.col("cagr"), F.coalesce(F.abs("year_dd"), F.abs("max_drawdown"))), "burke": F.when(F.col("year_dd2") > 0, F.col("cagr") / F.col("year_dd2")).otherwise(0.0), "martin": over(F.col("cagr"), F.col("ulcer_index")),
        "rolling6m_win_rate": F.coalesce("rolling6m_win_rate", F.lit(0.0)), "rolling6m_ir": F.coalesce("rolling6m_ir", F.lit(0.0)),
        "jensen_alpha": F.when(full, F.col("alpha") * 12).otherwise(0.0), "beta": F.when(full, F.col("beta")).otherwise(0.0), "appraisal": F.when(full & (resid > 1e-8), F.col("alpha") / resid).otherwise(0.0),
        "sqn": F.when((F.col("std_r") > 1e-8) & (F.col("months") > 1), F.col("mean_r") / F.col("std_r") * F.sqrt("months")).otherwise(0.0),
        "avg_monthly_turnover_cost": F.col("avg_monthly_turnover_cost"), "avg_annual_turnover_cost": F.col("avg_monthly_turnover_cost") * 12,
    }
    return a.select("series", *[c.alias(n) for n, c in out.items()])


#: Fixed values: (measure, bound); all are least values.
THRESHOLDS = (("ir", 0.5), ("calmar", 1.0), ("max_drawdown", -0.35), ("sortino", 1.2), ("annual_excess", 0.05), ("rolling6m_win_rate", 0.6), ("capture", 1.2), ("omega", 1.2))
MOST_PAIN = 0.10


def check_thresholds(found: DataFrame) -> DataFrame:
    """Pass or fail of each threshold, and of all."""
    tests = {f"pass_{m}": F.col(m) >= v for m, v in THRESHOLDS} | {"pass_pain_index": F.col("pain_index") <= MOST_PAIN}
    out = found.select("series", *[c.alias(n) for n, c in tests.items()])
    return out.withColumn("pass_all", F.forall(F.array(*tests), lambda x: x))


def lag_correlation(monthly: DataFrame, max_lag: int = 3, least: int = 5) -> DataFrame:
    """Correlation of portfolio and benchmark shifted by -k to k months; under five pairs NULL."""
    shifted = monthly.select("series", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), "month_idx", F.col("portfolio_return").alias("a"))
    other = monthly.select(F.col("series").alias("_s"), F.col("month_idx").alias("_m"), F.col("benchmark_return").alias("b"))
    both = shifted.join(other, (F.col("series") == F.col("_s")) & (F.col("month_idx") + F.col("lag") == F.col("_m")))
    return both.groupBy("series", "lag").agg(F.count("*").alias("pairs"), F.when(F.count("*") >= least, correlation("a", "b")).alias("r"))


def tier_returns(holdings: DataFrame) -> DataFrame:
    """Monthly return of each tier with weights renormalised within it."""
    held = holdings.filter("is_holding and target is not null")
    return held.groupBy("series", "tier", "month_idx").agg((F.sum(F.col("weight") * F.col("target")) / F.sum("weight")).alias("ret"))
