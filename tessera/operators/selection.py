"""Decisions: which features, windows, months and trials are used further, and the views that report on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import clip

from . import portfolio


def decide(df: DataFrame, features: list[str], min_rate: float = 0.3, min_std: float = 1e-6, max_corr: float = 0.9, min_abs: float = 0.02, min_keep: int = 2, label: str = "target") -> DataFrame:
    """(feature, verdict) of each feature, in the order of the tests: coverage, variance, correlation (with any earlier feature that passed these), ic, kept.

    If under min_keep features reach min_abs, the min_keep with the largest correlations stay. Tables of features only.
    """
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    stats = portfolio.screen(df, features, label).withColumn("place", place)
    first = F.when(F.col("coverage") < min_rate, "coverage").when(F.coalesce("std", F.lit(0.0)) < min_std, "variance")
    stats = stats.withColumn("first", first)
    usable = stats.filter("first is null").select("feature")
    pairs = portfolio.correlations(df.filter(F.col(label).isNotNull()), features).filter(F.abs("r") > max_corr)
    close = pairs.join(usable.withColumnRenamed("feature", "a"), "a", "left_semi").select(F.col("b").alias("feature")).distinct().withColumn("close", F.lit(True))
    stats = stats.join(close, "feature", "left").withColumn("second", F.coalesce("first", F.when(F.col("close"), "correlation")))
    left = W.partitionBy(F.col("second").isNull())
    enough = F.sum((F.coalesce("ic", F.lit(0.0)) >= min_abs).cast("int")).over(left) >= min_keep
    rank = F.row_number().over(left.orderBy(F.desc_nulls_last("ic"), "place"))
    kept = F.when(enough, F.coalesce("ic", F.lit(0.0)) >= min_abs).otherwise(rank <= min_keep)
    return stats.withColumn("verdict", F.coalesce("second", F.when(kept, "kept").otherwise("ic"))).select("feature", "verdict")


@dataclass
class Screen:
    """Features chosen on training rows; `apply` takes the same ones from any later rows."""

    features: list[str]

    @staticmethod
    def fit(train: DataFrame, features: list[str], **options) -> Screen:
        kept = {r["feature"] for r in decide(train, features, **options).filter("verdict = 'kept'").collect()}  # one row a feature
        return Screen([f for f in features if f in kept])

    def apply(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df.select(*keys, *self.features)


def last_n_windows(df: DataFrame, n: int, size: int = 49) -> DataFrame:
    """The rows of the last size + n - 1 months that exist: enough for n windows."""
    months = df.select("month_idx").distinct().orderBy(F.desc("month_idx")).limit(size + n - 1)
    return df.join(F.broadcast(months), "month_idx", "left_semi")  # at most size + n - 1 rows


def window_summary(gaps: DataFrame) -> DataFrame:
    """For each factor: windows, mean validation IC, mean gap, share of windows with low confidence."""
    return gaps.groupBy("factor").agg(F.count("*").alias("windows"), F.avg("val_ic").alias("mean_val_ic"), F.avg("gap").alias("mean_gap"), F.avg((F.col("confidence") == "LOW").cast("double")).alias("low_share"))


def mode_schema(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Months by the number of columns that have a value there, the commonest number first (ties: the larger)."""
    filled = panel.groupBy("month_idx").agg(*[F.count(c).alias(c) for c in columns])
    n = filled.select(sum((F.col(c) > 0).cast("int") for c in columns).alias("columns"))
    by = n.groupBy("columns").agg(F.count("*").alias("months"))
    return by.withColumn("expected", F.row_number().over(W.orderBy(F.desc("months"), F.desc("columns"))) == 1)


def monthly_rf(macro: DataFrame, rates: list[str], annual: float = 0.025) -> DataFrame:
    """Risk-free return of each month: the first rate (percent a year) with a value, else the annual one."""
    return macro.select("month_idx", (F.coalesce(*[F.col(c) / 100 for c in rates], F.lit(annual)) / 12).alias("rf"))


def month_keys(df: DataFrame) -> DataFrame:
    """Rows whose pred_month is six digits of a real month, with it as an integer; a missing name is ''."""
    ok = F.col("pred_month").rlike(r"^\d{4}(0[1-9]|1[0-2])$")
    return df.filter(ok).withColumns({"month_key": F.col("pred_month").cast("int"), "name": F.coalesce("name", F.lit(""))})


def with_cash(done: DataFrame, rf_annual: float = 0.025) -> DataFrame:
    """The overlay's holdings and, where weight was freed, a CASH_POOL row of the month with the risk-free return."""
    kept = done.filter("not sold").select("seq", F.col("entity").cast("string").alias("entity"), "weight", F.col("label").alias("action"), F.lit(None).cast("double").alias("ret"))
    cash = done.filter("sold").groupBy("seq").agg(F.sum("weight").alias("weight"))
    cash = cash.filter("weight > 0").select("seq", F.lit("CASH_POOL").alias("entity"), "weight", F.lit("CASH_POOL").alias("action"), F.lit(rf_annual / 12).alias("ret"))
    return kept.unionByName(cash)


def holdings_view(holdings: DataFrame, done: DataFrame) -> DataFrame:
    """Holdings with their contribution (the given one, else weight times return), and what the overlay did and why."""
    reason = F.format_string("%s: timing %.4f", "label", F.round("timing", 4))
    actions = done.select("entity", F.col("seq").alias("month_idx"), F.col("label").alias("action"), reason.alias("reason"))
    df = holdings.join(actions, ["entity", "month_idx"], "left")
    made = F.col("weight") * F.col("target")
    return df.withColumns({"contribution": F.coalesce("contribution", made) if "contribution" in holdings.columns else made, "action": F.coalesce("action", F.lit("HOLD"))})


def validation_extras(monthly: DataFrame, rf: float = 0.0025) -> DataFrame:
    """Measures of each series' validation months; under six months all are 0.

    Six-month frames count when full: downside ratios to rf, products of returns; the worst quarter is the mean over
    the deviation of the months at or below the lower quartile, within +-5.
    """
    order = W.partitionBy("series").orderBy("month_idx")
    six, full = order.rowsBetween(-5, 0), F.count("*").over(order.rowsBetween(-5, 0)) == 6
    below = F.when(F.col("net_return") < rf, F.col("net_return"))
    df = monthly.withColumn("_q", F.percentile("net_return", 0.25).over(W.partitionBy("series")))
    df = df.withColumns({
        "_ret6": F.when(full, F.product(1 + F.col("net_return")).over(six) - 1),
        "_ir6": F.when(full, F.when(F.stddev_samp("excess_return").over(six) > 1e-8, F.avg("excess_return").over(six) / F.stddev_samp("excess_return").over(six)).otherwise(0.0)),
        "_sortino6": F.when(full, F.when(F.stddev_samp(below).over(six) > 1e-8, (F.avg("net_return").over(six) - rf) / F.stddev_samp(below).over(six)).otherwise(0.0)),
        "_low": F.when(F.col("net_return") <= F.col("_q"), F.col("net_return")),
    })
    found = {
        "rolling6m_return": F.avg("_ret6"), "rolling6m_sortino": F.avg("_sortino6"), "ir_stability": F.stddev_pop("_ir6"), "excess_mean": F.avg("excess_return"), "annual_excess_mean": F.avg("excess_return") * 12,
        "pct_positive_excess": F.avg((F.col("excess_return") > 0).cast("double")), "worst_quartile": F.when(F.stddev_samp("_low") > 1e-8, clip(F.avg("_low") / F.stddev_samp("_low"), -5.0, 5.0)).otherwise(0.0), "turnover_penalty": F.avg("turnover_cost"),
    }
    enough = F.count("*") >= 6
    return df.groupBy("series").agg(F.count("*").alias("months"), *[F.when(enough, F.coalesce(v, F.lit(0.0))).otherwise(0.0).alias(k) for k, v in found.items()])


def cap_params(trials: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Long parameters (number, member, name, value): the prefix gives the member; sizes, depth and rate are capped, and rate * trees stays within 15 (100 trees at least)."""
    long = trials.select("number", F.explode("params").alias("key", "raw")).withColumn("value", F.expr("try_cast(raw as double)")).filter("value is not null")
    member = F.coalesce(*[F.when(F.col("key").startswith(p), F.lit(m)) for p, m in groups.items()], F.lit("shared"))
    name = F.regexp_replace("key", "^(" + "|".join(groups) + ")", "")
    df = long.select("number", member.alias("member"), name.alias("name"), "value")
    value = F.when(F.col("name") == "n_estimators", F.least("value", F.lit(500.0))).when(F.col("name") == "max_depth", F.least("value", F.lit(8.0))).when(F.col("name") == "learning_rate", F.greatest("value", F.lit(0.005))).otherwise(F.col("value"))
    df = df.withColumn("value", value)
    rate = F.max(F.when(F.col("name") == "learning_rate", F.col("value"))).over(W.partitionBy("number", "member"))
    trees = F.when((F.col("name") == "n_estimators") & (rate * F.col("value") > 15), F.greatest(F.floor(15 / rate).cast("double"), F.lit(100.0)))
    return df.withColumn("value", F.coalesce(trees, "value"))


def quality_gate(trials: DataFrame, rules: dict[str, Column], least: float = -900.0) -> DataFrame:
    """Trials with a value above `least` that meet every rule on their metrics; a missing metric fails its rule."""
    ok = F.col("value") > least
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(False))
    return trials.filter(ok)


def completed(trials: DataFrame, least: float = -900.0) -> DataFrame:
    """Completed trials with a value above `least`: what the gate is applied to."""
    return trials.filter((F.col("state") == "COMPLETE") & ~F.isnan("value") & (F.col("value") > least))


def standard_rules(trials: DataFrame) -> dict[str, Column]:
    """The gate's rules: information ratios over 0.05, most months ahead, under half penalised (by the first of two metrics that any trial has; none: no rule)."""
    m = lambda name: F.nanvl(F.col("attrs")[name], F.lit(None).cast("double"))
    rules = {"rolling": m("val_rolling6m_ir") > 0.05, "global": m("val_global_ir") > 0.05, "positive": m("pct_positive_excess") > 0.5}
    names = ("penalized_rate", "low_confidence_months_ratio")
    has = trials.agg(*[F.coalesce(F.bool_or(F.col("attrs")[n].isNotNull()), F.lit(False)).alias(n) for n in names]).first()
    name = next((n for n in names if has[n]), None)
    return rules | ({"penalized": m(name) < 0.5} if name else {})


def reuse(trials: DataFrame, scheme: str, ranges: dict[str, tuple[float, float]], weights: dict[str, float], top: int = 10) -> DataFrame:
    """The `top` trials of a scheme whose parameters lie in the ranges, scored anew by the weights, least first (ties: by number)."""
    df = trials.filter(F.col("scheme") == scheme)
    for p, (low, high) in ranges.items():
        df = df.filter(F.expr(f"try_cast(params['{p}'] as double)").between(low, high))
    score = sum((F.coalesce(F.nanvl(F.col("attrs")[m], F.lit(0.0)), F.lit(0.0)) * w for m, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", score).orderBy("score", "number").limit(top)


def verdict(qualified: DataFrame, all_trials: DataFrame, advice: DataFrame | None = None, least: int = 30, share: float = 0.5, converged: float = 0.7) -> DataFrame:
    """One row: how many trials pass, their share, the share of parameters that the advice fixes, and GO or RERUN.

    GO takes `least` passing trials and either more than `share` of all, or `converged` of the parameters fixed.
    """
    n, k = all_trials.agg(F.count("*").alias("trials")), qualified.agg(F.count("*").alias("qualified"))
    df = n.join(k).withColumn("pass_rate", F.try_divide("qualified", "trials"))  # one row each
    rate = F.lit(0.0)
    if advice is not None:
        df = df.join(advice.agg(F.coalesce(F.avg((F.col("advice") == "fix").cast("double")), F.lit(0.0)).alias("convergence")))
        rate = F.col("convergence")
    go = (F.col("qualified") >= least) & ((F.col("pass_rate") > share) | (rate >= converged))
    return df.withColumn("verdict", F.when(go, "GO").otherwise("RERUN"))
