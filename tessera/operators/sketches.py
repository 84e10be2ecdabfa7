"""Mergeable sketches as an option beside exact statistics: a state a month, stored once, merged for any window of months.

Distinct entities by HyperLogLog (2 ** HLL_BITS registers: a standard error of 1.04 / sqrt of them, 1.6 per cent), quantiles by KLL
(K items: ranks off by RANK_ERROR at the most in 99 of 100 cases). The states of a month are some kilobytes, whatever its
rows; a window reads its months' states, not their rows. Exact statistics stay what other operators use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_BITS, K, RANK_ERROR = 12, 400, 0.01


def month_states(df: DataFrame, columns: list[str], key: str = "entity") -> DataFrame:
    """month_idx, rows, keys (sketch of distinct keys), and a sketch of each column's values; missing values are left out."""
    values = [F.kll_sketch_agg_double(F.col(c).cast("double"), K).alias(c) for c in columns]
    return df.groupBy("month_idx").agg(F.count("*").alias("rows"), F.hll_sketch_agg(F.col(key).cast("string"), HLL_BITS).alias("keys"), *values)


def merged(states: DataFrame, windows: DataFrame, columns: list[str]) -> DataFrame:
    """States of (window_id, split) from those of its months."""
    both = states.join(windows, "month_idx")
    return both.groupBy("window_id", "split").agg(F.sum("rows").alias("rows"), F.hll_union_agg("keys").alias("keys"), *[F.kll_merge_agg_double(c).alias(c) for c in columns])


def estimates(states: DataFrame, columns: list[str], probabilities: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """rows, distinct keys, and the number of values and the quantiles of each column."""
    about = [x for c in columns for x in (F.kll_sketch_get_n_double(c).alias(f"{c}_n"), F.array(*[F.kll_sketch_get_quantile_double(F.col(c), F.lit(p)) for p in probabilities]).alias(f"{c}_q"))]
    own = [c for c in ("month_idx", "window_id", "split") if c in states.columns]
    return states.select(*own, "rows", F.hll_sketch_estimate("keys").alias("distinct_keys"), *about)


def within_bounds(df: DataFrame, windows: DataFrame, found: DataFrame, columns: list[str], probabilities: tuple[float, ...] = (0.05, 0.5, 0.95), key: str = "entity") -> DataFrame:
    """window_id, split, rows, keys_ok, quantiles_ok: estimates against the rows themselves. Keys within four standard errors (one at least); a quantile's rank within twice RANK_ERROR, among ties anywhere."""
    # windows and their estimates are small tables; a row meets those of its months and goes into sums at once
    rows = df.join(F.broadcast(windows.join(found.drop("rows"), ["window_id", "split"])), "month_idx")
    share = lambda c, i, op: F.avg(op(F.col(c), F.get(f"{c}_q", F.lit(i))).cast("double"))
    tests = []
    for c in columns:
        for i, p in enumerate(probabilities):
            below, upto = share(c, i, lambda a, b: a < b), share(c, i, lambda a, b: a <= b)
            tests.append((below <= p + 2 * RANK_ERROR) & (upto >= p - 2 * RANK_ERROR))
    sums = rows.groupBy("window_id", "split").agg(F.count("*").alias("rows"), F.max("distinct_keys").alias("_about"), reduce(lambda a, b: a & b, tests).alias("quantiles_ok"))
    # a key's months first, then the windows that have any of them: rows aren't copied into windows to be told apart
    of = windows.groupBy("month_idx").agg(F.collect_list(F.struct("window_id", "split")).alias("_w"))
    seen = df.filter(F.col(key).isNotNull()).select(key, "month_idx").distinct().join(F.broadcast(of), "month_idx").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("_w"))).alias("_w"))
    keys = seen.select(F.explode("_w").alias("w")).groupBy("w.window_id", "w.split").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    error = F.greatest(F.lit(1.0), n * 4 * 1.04 / 2 ** (HLL_BITS / 2))
    return sums.join(keys, ["window_id", "split"], "left").select("window_id", "split", "rows", (F.abs(n - F.col("_about")) <= error).alias("keys_ok"), "quantiles_ok")
