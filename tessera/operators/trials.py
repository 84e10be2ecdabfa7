"""Analysis of tuning trials: rows of (number, state, value, params map, attrs map)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import clip
from tessera.streaming.feeds import written

FAILED = -999.0


def valid(trials: DataFrame) -> DataFrame:
    """Completed trials with a finite value; failures carry FAILED."""
    return trials.filter((F.col("state") == "COMPLETE") & _finite(F.col("value")) & (F.col("value") > FAILED))


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def attributes(trials: DataFrame, column: str = "attrs") -> DataFrame:
    return trials.select("number", "value", F.explode(column).alias("metric", "x"))


def metric_quantiles(trials: DataFrame) -> DataFrame:
    """Quantiles, range, mean, deviation, and the shares of positive values, zeros and missing values of each metric over valid trials."""
    rows = valid(trials)
    long = attributes(rows)
    known = F.when(~F.isnan("x"), F.col("x"))
    q = F.percentile(known, [0.05, 0.25, 0.5, 0.75, 0.95])
    return long.groupBy("metric").agg(
        *[q[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], F.min(known).alias("min"), F.max(known).alias("max"), F.avg(known).alias("mean"), F.stddev_pop(known).alias("std"),
        F.avg((known > 0).cast("double")).alias("positive_rate"), F.avg((known == 0).cast("double")).alias("zero_rate"), F.avg(known.isNull().cast("double")).alias("missing_rate"),
    )


#: How each metric is normalised without data: bounds of linear ones, scales of tanh ones, signed logarithms.
LINEAR = {
    "val_ic": (-0.05, 0.05), "pct_positive_excess": (0.30, 0.70), "penalized_rate": (0.0, 0.50), "ic_gap_penalty": (0.0, 0.30), "monthly_win_rate": (0.30, 0.70),
    "capture_ratio": (0.0, 5.0), "up_capture_ratio": (0.3, 2.0), "down_capture_ratio": (0.0, 1.5), "var_95": (-0.15, 0.0), "cvar_95": (-0.20, 0.0), "pain_index": (0.0, 0.15),
    "ulcer_index": (0.0, 0.20), "max_drawdown": (-0.40, 0.0), "rolling6m_win_rate": (0.30, 0.80), "downside_volatility": (0.0, 0.20), "upside_volatility": (0.0, 0.30),
    "avg_monthly_turnover_cost": (0.0, 0.02), "avg_annual_turnover_cost": (0.0, 0.20),
}
TANH = {
    "val_icir": 2.0, "val_rolling6m_ir": 1.5, "val_global_ir": 1.5, "val_rolling6m_sortino": 2.0, "ir_worst_quartile": 2.0, "val_jensen_alpha": 0.05, "val_appraisal_ratio": 0.5,
    "val_beta": 0.5, "val_ic_stability": 0.05, "val_sqn": 2.0, "sharpe_ratio": 1.0, "sortino_ratio": 1.0, "calmar_ratio": 1.0, "ir": 1.0, "rolling6m_ir": 1.0, "omega_ratio": 1.0,
    "tail_ratio": 1.0, "burke_ratio": 1.0, "martin_ratio": 1.0, "sterling_ratio": 1.0, "volatility_ratio": 1.0, "skewness": 1.0, "kurtosis": 3.0,
}
LOG = ("val_annual_return", "val_rolling6m_return", "val_rolling6m_excess", "val_rolling6m_excess_ann", "cagr", "net_cagr_after_cost", "annual_excess")
#: The metric whose weight counts one and a half times, and the score of a trial that has none.
PENALTY, PENALTY_WEIGHT, NO_SCORE = "ic_gap_penalty", 1.5, -1000.0


def _setting(metric: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), metric)


def normalize_static(metric: Column, x: Column) -> Column:
    """Linear within bounds to +-0.5, tanh(x / scale), or signed log, by metric; others as they are, missing values 0."""
    x = F.when(_finite(x), x).otherwise(0.0)
    low, high = _setting(metric, {k: a for k, (a, _) in LINEAR.items()}), _setting(metric, {k: b for k, (_, b) in LINEAR.items()})
    scale = _setting(metric, TANH)
    return F.when(low.isNotNull(), (clip(x, low, high) - low) / (high - low) - 0.5).when(scale.isNotNull(), F.tanh(x / scale)).when(metric.isin(*LOG), F.signum(x) * F.log1p(F.abs(x))).otherwise(x)


def normalize_adaptive(long: DataFrame, anchor: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """number, metric, x, z, corrupt: tanh((x - p50) / max((p95 - p5) / 2, 1e-6)), linear metrics by [p5, p95].

    A metric's quantiles are the anchor's, else the study's own, else it is normalised without data. Metrics that are
    mostly missing or zero are corrupt and give 0, as do values that aren't finite, and quantiles that are missing.
    """
    stats = ["p5", "p50", "p95", "zero_rate", "missing_rate"]
    table = anchor.select("metric", *stats)
    if own is not None:
        table = table.unionByName(own.join(anchor, "metric", "left_anti").select("metric", *stats))
    df = long.join(table.withColumn("known", F.lit(True)), "metric", "left")
    corrupt = F.coalesce((F.col("zero_rate") > 0.9) | (F.col("missing_rate") > 0.9), F.lit(False))
    span, x = F.col("p95") - F.col("p5"), F.col("x")
    linear = (clip(x, F.col("p5"), F.col("p95")) - F.col("p5")) / F.greatest(span, F.lit(1e-6)) - 0.5
    scaled = F.when(F.col("metric").isin(*LINEAR), linear).otherwise(F.tanh((x - F.col("p50")) / F.greatest(span / 2, F.lit(1e-6))))
    z = F.when(corrupt | ~_finite(x), 0.0).when(F.col("known"), F.coalesce(scaled, F.lit(0.0))).otherwise(normalize_static(F.col("metric"), x))
    return df.select("number", "metric", "x", z.alias("z"), corrupt.alias("corrupt"))


def score(normalized: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of each trial's normalised metrics; weights (metric, weight, direction -1 or 1)."""
    return normalized.join(weights, "metric").groupBy("number").agg(F.sum(F.col("z") * F.col("weight") * F.col("direction")).alias("score"), F.count_if(F.col("z") != 0).alias("used"))


def score_trials(trials: DataFrame, weights: dict[str, tuple[float, str]], anchor: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """number, raw_score, score, metrics: sums over all weighted metrics, (weight, "max" or "min") each; a metric that a trial lacks counts as 0.

    raw_score sums the values, score the normalised ones (the values, without quantiles); the gap's penalty weighs
    PENALTY_WEIGHT times; sums that aren't finite become NO_SCORE; metrics counts those that aren't corrupt.
    """
    terms = [F.struct(F.lit(m).alias("metric"), F.coalesce(F.col("attrs")[m], F.lit(0.0)).alias("x"), F.lit(w * (PENALTY_WEIGHT if m == PENALTY else 1.0) * (1 if d == "max" else -1)).alias("w")) for m, (w, d) in weights.items()]
    long = valid(trials).select("number", F.explode(F.array(*terms)).alias("t")).select("number", "t.*")
    if anchor is None:
        done = long.withColumns({"z": F.col("x"), "corrupt": F.lit(False)})
    else:
        signed = _setting(F.col("metric"), {m: w * (PENALTY_WEIGHT if m == PENALTY else 1.0) * (1 if d == "max" else -1) for m, (w, d) in weights.items()})
        done = normalize_adaptive(long.select("number", "metric", "x"), anchor, own).withColumn("w", signed)
    sums = done.groupBy("number").agg(F.sum(F.col("w") * F.col("x")).alias("raw_score"), F.sum(F.col("w") * F.col("z")).alias("score"), F.count_if(~F.col("corrupt")).alias("metrics"))
    return sums.withColumn("score", F.when(_finite(F.col("score")), F.col("score")).otherwise(NO_SCORE))


def filter_trials(trials: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Valid trials with each metric in its range; a missing metric passes."""
    return valid(trials).filter(_matches(ranges))


def _matches(ranges: dict[str, tuple[float, float]]) -> Column:
    ok = F.lit(True)
    for name, (low, high) in ranges.items():
        x = F.col("attrs")[name]
        ok = ok & (x.isNull() | F.isnan(x) | x.between(low, high))
    return ok


def count_matched(trials: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: the valid trials that pass the ranges, and all valid ones."""
    return valid(trials).agg(F.count_if(_matches(ranges)).alias("matched"), F.count("*").alias("total"))


def metric_ranges(trials: DataFrame, margin: float = 0.05) -> DataFrame:
    """Least and greatest finite value of each metric over valid trials with a margin of the span; under two values NULL, flat [0, 1]."""
    long = attributes(valid(trials)).filter(~F.isnan("x"))
    g = long.groupBy("metric").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    span = (F.col("b") - F.col("a")) * margin
    pick = lambda flat, x: F.when(F.col("n") < 2, None).when(F.col("a") == F.col("b"), flat).otherwise(x)
    return g.select("metric", pick(0.0, F.col("a") - span).alias("low"), pick(1.0, F.col("b") + span).alias("high"))


#: Bins of a histogram that looks for an order statistic: what the driver holds of a pass.
BINS = 1024


def kth(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th smallest number of a column, exactly: histograms of ever narrower ranges, one aggregation each, until a bin holds one value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        bins = df.filter(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for b in sorted(bins, key=lambda b: b["bin"]):
            if k <= b["n"]:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return low


def first_rows(rows: DataFrame, k: int, ascending: bool = True) -> Column:
    """Whether a row is among the k first by value, ties by number: the value at the cut by `kth`, then the number at the cut among its ties. No row is moved."""
    if k < 1:
        return F.lit(False)
    df = written(rows.select((F.col("value") if ascending else -F.col("value")).alias("_v"), "number"))  # what the histograms read again and again
    at = kth(df, "_v", k)
    if at is None:
        return F.lit(False)
    ties = df.filter(F.col("_v") == at)
    before = df.filter(F.col("_v") < at).count()
    last = kth(ties, "number", k - before)
    value = F.col("value") if ascending else -F.col("value")
    return (value < at) | ((value == at) & (F.col("number") <= last))


def best_share(trials: DataFrame, share: float, ascending: bool = True) -> DataFrame:
    """The best share of the valid trials, at least one; small values are best unless told otherwise."""
    rows = valid(trials)
    return rows.filter(first_rows(rows, max(1, int(rows.count() * share + 1e-9)), ascending))


def modes(long: DataFrame) -> DataFrame:
    """param, mode, frequency of (param, v); equal counts go to the greater value."""
    counts = long.groupBy("param", "v").agg(F.count("*").alias("k"))
    return counts.groupBy("param").agg(F.max_by("v", F.struct("k", "v")).alias("mode"), (F.max("k") / F.sum("k")).alias("frequency"))


def param_ranges(trials: DataFrame, share: float = 0.2, fixed_at: float = 0.8, ascending: bool = True, whole: tuple[str, ...] = ()) -> DataFrame:
    """Of the best trials: each numeric parameter's range (outwards to integers for those named in whole), each other parameter's mode, its frequency, and whether that is fixed."""
    best = best_share(trials, share, ascending)
    long = best.select(F.explode("params").alias("param", "v")).withColumn("x", F.expr("try_cast(v as double)"))
    numeric = long.groupBy("param").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("numbers"))
    integer, other = F.col("param").isin(*whole), F.col("numbers") == 0
    low, high = F.when(integer, F.floor("low").cast("double")).otherwise(F.round("low", 4)), F.when(integer, F.ceil("high").cast("double")).otherwise(F.round("high", 4))
    return numeric.join(modes(long), "param").select("param", low.alias("low"), high.alias("high"), F.when(other, F.col("mode")).alias("mode"), F.when(other, F.col("frequency")).alias("frequency"), F.when(other, F.col("frequency") >= fixed_at).alias("fixed"))


def health(trials: DataFrame, key_metrics: tuple[str, ...] = ("val_ic", "val_icir")) -> DataFrame:
    """Counts of trials by what is wrong with them."""
    value = F.col("value")
    absent = F.lit(True)
    for m in key_metrics:
        absent = absent & F.col("attrs")[m].isNull()
    real = (F.col("state") == "COMPLETE") & ~F.isnan(value) & (value > FAILED)
    a, b = (F.col("attrs")[m] for m in key_metrics[:2])
    return trials.agg(
        F.count("*").alias("trials"), F.count_if(F.col("state") == "FAIL").alias("failed"), F.count_if(F.col("state") == "RUNNING").alias("running"), F.count_if(F.isnan(value)).alias("nan_value"), F.count_if(value == FAILED).alias("failure_value"),
        F.count_if(absent).alias("no_metrics"), F.count_if(real & (F.signum(a) * F.signum(b) < 0)).alias("sign_clash"), F.min(F.when(real, value)).alias("best"),
    )


#: Metrics of which one at least must be there, those that must be finite, and the limits of the sign and ratio tests.
REQUIRED = ("val_ic", "val_icir", "val_rolling6m_ir", "val_global_ir")
CRITICAL = ("val_ic", "val_icir", "val_rolling6m_ir", "pct_positive_excess", "val_global_ir")
SIGN_FROM, RATIO_MOST = 0.1, 10.0


def diagnosis(trials: DataFrame) -> Column:
    """What is wrong with a trial, the first that applies, or ok: failed, running, not_finite, failure_value, no_metrics, no_required, bad_metric, sign_clash, ratio."""
    m = lambda name: F.col("attrs")[name]
    none = lambda names, test: F.forall(F.array(*[m(n) for n in names]), test)
    value, ic, icir, rolling, whole = F.col("value"), m("val_ic"), m("val_icir"), m("val_rolling6m_ir"), m("val_global_ir")
    return (
        F.when(F.col("state") == "FAIL", "failed").when(F.col("state") != "COMPLETE", "running").when(~_finite(value), "not_finite").when(value <= FAILED, "failure_value")
        .when(F.coalesce(F.size("attrs"), F.lit(0)) <= 0, "no_metrics").when(none(REQUIRED, lambda x: x.isNull()), "no_required").when(~none(CRITICAL, lambda x: x.isNull() | _finite(x)), "bad_metric")
        .when((F.abs(ic) > SIGN_FROM) & ((ic > 0) != (icir > 0)), "sign_clash").when((F.abs(whole) > 1e-6) & (F.abs(rolling) / F.abs(whole) > RATIO_MOST), "ratio").otherwise("ok")
    )


def study_health(trials: DataFrame, elapsed: str = "elapsed_sec") -> DataFrame:
    """For each diagnosis: trials, the best value (the least, of ok trials), and count, sum, mean, least and greatest of the positive elapsed seconds of completed trials."""
    sec = F.col("attrs")[elapsed]
    took = F.when((F.col("state") == "COMPLETE") & _finite(sec) & (sec > 0), sec)
    df = trials.withColumn("diagnosis", diagnosis(trials)).withColumn("_s", took)
    return df.groupBy("diagnosis").agg(F.count("*").alias("trials"), F.min(F.when(F.col("diagnosis") == "ok", F.col("value"))).alias("best"), F.count("_s").alias("timed"), F.sum("_s").alias("seconds"), F.avg("_s").alias("mean_seconds"), F.min("_s").alias("least_seconds"), F.max("_s").alias("most_seconds"))


def convergence(trials: DataFrame, ascending: bool = True, categorical: tuple[str, ...] = ()) -> DataFrame:
    """Mean and deviation of each numeric parameter in the better and the worse half; converged if the deviation has fallen under 0.7 of the other and 0.3 of the mean.

    The one in the middle of an odd number is in neither half. Parameters named in categorical have the better half's mode and its frequency instead.
    """
    rows = valid(trials)
    n = rows.count()
    top = first_rows(rows, n // 2, ascending)
    middle = first_rows(rows, n // 2 + 1, ascending) & ~top if n % 2 else F.lit(False)
    long = rows.filter(~middle).select(top.alias("_top"), F.explode("params").alias("param", "v"))
    sorts = F.col("param").isin(*categorical)
    x = long.filter(~sorts).withColumn("x", F.expr("try_cast(v as double)")).filter("x is not null")
    part = lambda of: F.when(F.col("_top") == of, F.col("x"))
    g = x.groupBy("param").agg(F.avg(part(True)).alias("top_mean"), F.stddev_samp(part(True)).alias("top_std"), F.avg(part(False)).alias("rest_mean"), F.stddev_samp(part(False)).alias("rest_std"))
    ratio, cv = F.try_divide("top_std", "rest_std"), F.col("top_std") / (F.abs("top_mean") + 1e-8)
    g = g.withColumn("converged", F.coalesce((ratio < 0.7) & (cv < 0.3), F.lit(False)))
    if not categorical:
        return g
    return g.unionByName(modes(long.filter(sorts & F.col("_top")).select("param", "v")), allowMissingColumns=True)


def search_advice(trials: DataFrame, share: float = 0.25, ascending: bool = True, categorical: tuple[str, ...] = (), whole: tuple[str, ...] = (), k: float = 1.0, fixed_at: float = 0.8) -> DataFrame:
    """For each parameter of the best trials: fix (a deviation under 0.15 of the mean; a mode of over fixed_at), or a range or search, with its ends or value.

    Ranges are mean +- k deviations; of whole parameters rounded, from 0 on.
    """
    best = best_share(trials, share, ascending)
    long = best.select(F.explode("params").alias("param", "v"))
    sorts, integer = F.col("param").isin(*categorical), F.col("param").isin(*whole)
    x = long.filter(~sorts).withColumn("x", F.expr("try_cast(v as double)")).filter("x is not null").groupBy("param").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    fix = F.col("s") / (F.abs("m") + 1e-8) < 0.15
    to = lambda c: F.when(integer, F.greatest(F.round(c), F.lit(0.0))).otherwise(F.round(c, 6))
    low, high = F.when(fix, F.col("m")).otherwise(F.col("m") - k * F.col("s")), F.when(fix, F.col("m")).otherwise(F.col("m") + k * F.col("s"))
    numeric = x.select("param", F.when(fix, "fix").otherwise("range").alias("advice"), to(low).alias("low"), to(high).alias("high"), F.lit(None).cast("string").alias("mode"))
    nothing = F.lit(None).cast("double")
    named = modes(long.filter(sorts)).select("param", F.when(F.col("frequency") > fixed_at, "fix").otherwise("search").alias("advice"), nothing.alias("low"), nothing.alias("high"), "mode")
    return numeric.unionByName(named)


def top_k(trials: DataFrame, k: int = 10) -> DataFrame:
    """The k best trials with their parameters as JSON: a top-k report."""
    rows = valid(trials).orderBy("value", "number").limit(k)
    return rows.select("number", "value", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params")))).alias("params_json"))


def warm_start(trials: DataFrame, ranges: dict[str, tuple[float, float]], k: int = 3) -> DataFrame:
    """The k best trials whose metrics lie in the ranges: where the next search begins."""
    return top_k(filter_trials(trials, ranges), k)
