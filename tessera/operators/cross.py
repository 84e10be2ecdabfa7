"""Operators on cross-sections in long form (month_idx, factor, entity, y): standardising, ranking, neutralising, testing.

Rows aren't moved: what a cross-section (month, factor) says of itself is aggregated, written as a small table and joined
back. Medians and ranks come from the distinct values of each cross-section and their counts. The least-squares residuals
come in closed form: industry dummies are removed by demeaning (Frisch-Waugh-Lovell), what is left is a few sums; only
schemes with a block of regressors solve small normal equations, one row for each (month, factor), in a pandas function.
Operators read their rows several times, so these should be a stored table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank, clip, correlation, inv_norm
from tessera.streaming.feeds import written

CELL = ("month_idx", "factor")
def _cell():
    return W.partitionBy(*CELL)



def long_form(panel: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """One row for each entity and factor of a wide panel."""
    return panel.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("y")) for f in factors])).alias("z")).select(*keep, "z.factor", "z.y")


def _matched(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of the table, whose keys are unique; NULL keys match."""
    right = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(right, same, "left").drop(*[f"_key_{k}" for k in keys])


def _with(df: DataFrame, keys: tuple[str, ...], **aggregates: Column) -> DataFrame:
    """df with aggregates of its groups: a row for each month, factor and at most industry, so the table is small, whatever the number of rows."""
    return _matched(df, F.broadcast(written(df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()]))), list(keys))


def _counts(df: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """keys, y, _k: the distinct values of each group and how often they occur."""
    return df.filter("y is not null").groupBy(*keys, "y").agg(F.count("*").alias("_k"))


def _ranks(counts: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """counts with _rank, the average-tie rank of each value from 1, and _n, the number of values."""
    cell = W.partitionBy(*keys)
    upto = F.sum("_k").over(cell.orderBy("y").rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumns({"_rank": upto - (F.col("_k") - 1) / 2, "_n": F.sum("_k").over(cell)})


def _mapped(df: DataFrame, values: DataFrame, out: str, keys: tuple[str, ...] = CELL) -> DataFrame:
    """df with `out` from values (keys, y, _out), written so that its size decides how it is joined; a missing y gives NULL."""
    table = written(values.select(*keys, "y", "_out"))
    both = _matched(df, table, [*keys, "y"])
    return both.withColumn(out, F.col("_out")).drop("_out")


def zscore(df: DataFrame, y: str = "y", out: str = "z") -> DataFrame:
    """(y - mean) / population std; a flat cross-section gives 0, fewer than two values NULL."""
    df = _with(df, CELL, _m=F.avg(y), _s=F.stddev_pop(y), _n=F.count(y))
    return df.withColumn(out, F.when(F.col(y).isNull() | (F.col("_n") < 2), F.lit(None)).when(F.col("_s") < 1e-8, 0.0).otherwise((F.col(y) - F.col("_m")) / F.col("_s"))).drop("_m", "_s", "_n")


def zscore_fill(df: DataFrame) -> DataFrame:
    """Missing values as 0 first, then (y - mean) / (population std + 1e-6)."""
    y = F.coalesce("y", F.lit(0.0))
    return _with(df, CELL, _m=F.avg(y), _s=F.stddev_pop(y)).withColumn("z", (y - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def _winsorized(counts: DataFrame, n: float = 3.0) -> DataFrame:
    """counts with _w, the value within the bounds of its cross-section."""
    counts = _with(counts, CELL, _med=F.percentile("y", 0.5, F.col("_k")), _n=F.sum("_k")).withColumn("_dev", F.abs(F.col("y") - F.col("_med")))
    counts = _with(counts, CELL, _mad=F.percentile("_dev", 0.5, F.col("_k")))
    w = n * 1.4826 * F.col("_mad")
    value = F.when((F.col("_mad") < 1e-8) | (F.col("_n") < 2), F.col("y")).otherwise(clip(F.col("y"), F.col("_med") - w, F.col("_med") + w))
    return counts.withColumn("_w", value).drop("_med", "_dev", "_mad", "_n")


def _normal(counts: DataFrame, version: int) -> DataFrame:
    """counts with _out, the normal scores of the average-tie ranks."""
    ranked = _ranks(counts)
    if version == 1:
        value = F.when(F.col("_n") < 10, F.col("y")).otherwise(inv_norm(F.col("_rank") / (F.col("_n") + 1)))
    else:
        value = F.when(F.col("_n") >= 2, inv_norm(clip((F.col("_rank") - 0.5) / F.col("_n"), 1e-6, 1 - 1e-6)))
    return ranked.withColumn("_out", value)


def winsorize(df: DataFrame, n: float = 3.0, out: str = "y") -> DataFrame:
    """y within median +- n * 1.4826 * median absolute deviation; flat or single cross-sections as they are."""
    return _mapped(df, _winsorized(written(_counts(df)), n).withColumn("_out", F.col("_w")), out)


def rank_normal(df: DataFrame, version: int = 1, out: str = "y") -> DataFrame:
    """Normal scores of average-tie ranks. v1: rank / (n + 1), as it is under 10 values; v2: (rank - 0.5) / n, NULL under 2. A flat cross-section gives 0."""
    return _mapped(df, _normal(_counts(df), version), out)


def rank_pct(df: DataFrame, keys: tuple[str, ...] = (*CELL, "industry"), out: str = "y") -> DataFrame:
    """Average-tie rank of y in its group over the number of values there."""
    return _mapped(df, _ranks(_counts(df, keys), keys).withColumn("_out", F.col("_rank") / F.col("_n")), out, keys)


def _with_base_industry(df: DataFrame) -> DataFrame:
    """A missing industry shares the intercept of the first one, as the dummies drop it."""
    return _with(df, CELL, _first=F.min("industry")).withColumn("_ind", F.coalesce("industry", "_first")).drop("_first")


def _demeaned(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    mean = (lambda c: F.avg(c)) if weight is None else (lambda c: F.sum(F.col(weight) * F.col(c)) / F.sum(weight))
    df = _with(df, (*CELL, "_ind"), **{f"_a{c}": mean(c) for c in columns})
    return df.withColumns({f"_d{c}": F.col(c) - F.col(f"_a{c}") for c in columns}).drop(*[f"_a{c}" for c in columns])


def industry_size_residual(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Residual e of y on the log of size and industry dummies (weighted if asked); unweighted, a cross-section with a missing size keeps y."""
    df = _demeaned(_with_base_industry(df).withColumn("_x", F.log(F.greatest("market_cap", F.lit(1.0)))), ["y", "_x"], weight)
    w = F.col(weight) if weight else F.lit(1.0)
    df = _with(df, CELL, _sxx=F.sum(w * F.col("_d_x") * F.col("_d_x")), _sxy=F.sum(w * F.col("_d_x") * F.col("_dy")), _unknown=F.count_if(F.col("market_cap").isNull()) > 0)
    beta = F.when(F.col("_sxx") > 1e-12, F.col("_sxy") / F.col("_sxx")).otherwise(0.0)
    unknown = F.lit(False) if weight else F.col("_unknown")
    return df.withColumn("e", F.when(unknown, F.col("y")).otherwise(F.col("_dy") - beta * F.col("_d_x"))).drop("_ind", "_x", "_dy", "_d_x", "_sxx", "_sxy", "_unknown")


def neutralize_a(df: DataFrame) -> DataFrame:
    """Industry and size out, missing values as 0 first; standardised."""
    return zscore(industry_size_residual(df.withColumn("y", F.coalesce("y", F.lit(0.0)))), "e")


def neutralize_b(df: DataFrame) -> DataFrame:
    """Winsorised and rank-normalised before scheme A; values that are cut to one are ranked as one."""
    cut = written(_winsorized(written(_counts(df))))
    normal = _normal(cut.groupBy(*CELL, F.col("_w").alias("y")).agg(F.sum("_k").alias("_k")), 1).select(*CELL, F.col("y").alias("_w"), "_out")
    return neutralize_a(_mapped(df, cut.join(normal, [*CELL, "_w"]), "y"))


def neutralize_d(df: DataFrame) -> DataFrame:
    """Industry alone out."""
    df = _demeaned(_with_base_industry(df.withColumn("y", F.coalesce("y", F.lit(0.0)))), ["y"]).withColumn("e", F.col("_dy")).drop("_ind", "_dy")
    return zscore(df, "e")


def neutralize_e(df: DataFrame) -> DataFrame:
    """Winsorised, ranked within the industry, then size alone out."""
    df = rank_pct(winsorize(df)).withColumn("y", F.coalesce("y", F.lit(0.0))).withColumn("_x", F.log(F.greatest("market_cap", F.lit(1.0))))
    df = _with(df, CELL, _slope=F.regr_slope("y", "_x"), _intercept=F.regr_intercept("y", "_x"), _unknown=F.count_if(F.col("market_cap").isNull()) > 0)
    e = F.when(F.col("_unknown"), F.col("y")).otherwise(F.col("y") - F.col("_intercept") - F.col("_slope") * F.col("_x"))
    return zscore(df.withColumn("e", e).drop("_x", "_slope", "_intercept", "_unknown"), "e")


def neutralize_b2(df: DataFrame) -> DataFrame:
    """Weighted by the root of size; missing values come back as missing."""
    df = df.withColumn("_miss", F.col("y").isNull()).withColumn("y", F.coalesce("y", F.lit(0.0)))
    root = F.when(F.col("market_cap") > 0, F.sqrt("market_cap")).otherwise(0.0)
    df = _with(df, CELL, _root=F.avg(root)).withColumn("_w", root / F.col("_root")).drop("_root")
    df = industry_size_residual(df, "_w").withColumn("e", F.when(~F.col("_miss"), F.col("e")))
    return zscore(df.drop("_w", "_miss"), "e")


def block_residual(df: DataFrame, regressors: list[str], out: str = "e") -> DataFrame:
    """Residual of y on a block of regressors and industry dummies: normal equations are summed by Spark, solved for each cell, and joined back."""
    df = _demeaned(_with_base_industry(df), ["y", *regressors])
    d = [f"_d{c}" for c in regressors]
    pairs = [(i, j) for i in range(len(d)) for j in range(i, len(d))]
    sums = [F.sum(F.col(d[i]) * F.col(d[j])).alias(f"x{i}_{j}") for i, j in pairs] + [F.sum(F.col(c) * F.col("_dy")).alias(f"y{i}") for i, c in enumerate(d)]
    gram = df.groupBy(*CELL).agg(*sums)
    k = len(d)

    @F.pandas_udf("array<double>")
    def solve(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(float) for c in columns])
        out = []
        for row in values:
            a = np.zeros((k, k))
            for (i, j), v in zip(pairs, row, strict=False):
                a[i, j] = a[j, i] = v
            ok = np.isfinite(row).all()
            out.append(np.linalg.lstsq(a, row[len(pairs) :], rcond=1e-5)[0].tolist() if ok else [0.0] * k)
        return pd.Series(out)

    names = [f"x{i}_{j}" for i, j in pairs] + [f"y{i}" for i in range(k)]
    betas = F.broadcast(written(gram.select(*CELL, solve(*names).alias("_beta"))))  # a row for each month and factor
    fitted = reduce(lambda a, b: a + b, [F.col("_beta")[i] * F.col(c) for i, c in enumerate(d)])
    return _matched(df, betas, list(CELL)).withColumn(out, F.col("_dy") - fitted).drop("_beta", "_ind", "_dy", *d)


def neutralize_b1(df: DataFrame) -> DataFrame:
    """Rank-normalised (v2); log size, its square and cube, and industries out; missing values come back as missing."""
    df = df.withColumn("_miss", F.col("y").isNull())
    df = rank_normal(df, 2).withColumn("y", F.coalesce("y", F.lit(0.0)))
    x = F.log(F.greatest("market_cap", F.lit(1.0)))
    df = _with(df, CELL, _mx=F.avg(x)).withColumn("_s", x - F.col("_mx")).withColumns({"_s2": F.col("_s") ** 2, "_s3": F.col("_s") ** 3})
    df = block_residual(df, ["_s", "_s2", "_s3"]).withColumn("e", F.when(~F.col("_miss"), F.col("e")))
    return zscore(df.drop("_s", "_s2", "_s3", "_miss", "_mx"), "e")


#: The slots of the style block; of each, the first name that the table has is taken.
STYLE_SLOTS = {
    "momentum_return_20d": ("momentum_return_20d", "momentum_log_return_20d", "momentum_20d"),
    "momentum_return_60d": ("momentum_return_60d", "momentum_log_return_60d", "momentum_60d"),
    "volatility_20d": ("volatility_20d", "volatility_hist_20d", "jq_volatility_20d"),
    "volatility_60d": ("volatility_60d", "volatility_hist_60d", "jq_volatility_60d"),
    "liquidity_turnover_20d": ("liquidity_turnover_20d", "liquidity_avg_turnover_20d", "jq_turnover_20d", "turnover_rate_20d"),
    "liquidity_turnover_60d": ("liquidity_turnover_60d", "liquidity_avg_turnover_60d", "jq_turnover_60d", "turnover_rate_60d"),
    "rsi_14": ("rsi_14", "technical_rsi_14"),
    "beta_60d": ("beta_60d", "technical_beta_60d"),
}


def style_columns(columns: list[str], styles: list[str] | None = None) -> list[str]:
    """The named style columns, all of which must be there, or else a column for each slot that has one; none at all is an error."""
    if styles is None:
        styles = [found for names in STYLE_SLOTS.values() if (found := next((n for n in names if n in columns), None))]
    absent = [s for s in styles if s not in columns]
    if absent or not styles:
        raise ValueError(f"style columns are missing: {absent}")
    return styles


def _inverses(gram: DataFrame, pairs: list[tuple[int, int]], k: int) -> DataFrame:
    """month_idx, inverse: the pseudo-inverse of a month's k x k products, row by row; directions under 1e-10 of the greatest are left out."""

    @F.pandas_udf("array<double>")
    def inverse(*columns: pd.Series) -> pd.Series:
        out = []
        for row in np.column_stack([c.to_numpy(float) for c in columns]):
            a = np.zeros((k, k))
            for (i, j), v in zip(pairs, row, strict=True):
                a[i, j] = a[j, i] = v
            out.append(np.linalg.pinv(a, rcond=1e-10, hermitian=True).ravel().tolist())
        return pd.Series(out)

    return gram.select("month_idx", inverse(*[f"x{i}_{j}" for i, j in pairs]).alias("_inverse"))


def neutralize_f(df: DataFrame, exposures: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """Log size, industries and a block of rank-normalised style columns out of rank-normalised factors, the styles among them.

    df: entity, month_idx, factor, y; exposures: entity, month_idx, market_cap, industry and the style columns (see
    `style_columns`), one row an entity and month. A style column is a factor to neutralise as well, whether df has it or
    not. Missing values are 0 in the fit and come back as missing. All factors of a month share its regressors, so their
    products are summed and inverted once a month; a factor adds one sum for each regressor.
    """
    styles = style_columns(exposures.columns, styles)
    keys = ["entity", "month_idx"]
    long = df.filter(~F.col("factor").isin(*styles)).select(*keys, "factor", F.col("y").cast("double").alias("y")).unionByName(long_form(exposures, styles, keys))
    long = rank_normal(long, 2)
    normal = long.filter(F.col("factor").isin(*styles)).groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("factor") == s, F.col("y"))), F.lit(0.0)).alias(f"_n{i}") for i, s in enumerate(styles)])
    x = exposures.select(*keys, F.log(F.greatest("market_cap", F.lit(1.0))).alias("_size"), "industry").join(normal, keys)
    columns = ["_size", *[f"_n{i}" for i in range(len(styles))]]
    x = x.withColumn("_ind", F.coalesce("industry", F.min("industry").over(W.partitionBy("month_idx"))))
    by_industry = W.partitionBy("month_idx", "_ind")
    x = x.select(*keys, "_ind", *[(F.col(c) - F.avg(c).over(by_industry)).alias(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    gram = x.groupBy("month_idx").agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"x{i}_{j}") for i, j in pairs])
    inverses = _inverses(gram, pairs, len(columns))

    rows = long.withColumn("_miss", F.col("y").isNull()).withColumn("y", F.coalesce("y", F.lit(0.0))).join(x, keys)
    sums = rows.groupBy(*CELL).agg(F.array(*[F.sum(F.col(c) * F.col("y")) for c in columns]).alias("_xy")).join(inverses, "month_idx")
    k = len(columns)
    betas = sums.select(*CELL, F.array(*[reduce(lambda a, b: a + b, [F.col("_inverse")[i * k + j] * F.col("_xy")[j] for j in range(k)]) for i in range(k)]).alias("_beta"))
    fitted = reduce(lambda a, b: a + b, [F.col("_beta")[i] * F.col(c) for i, c in enumerate(columns)])
    left = F.col("y") - F.avg("y").over(W.partitionBy(*CELL, "_ind")) - fitted
    rows = rows.join(betas, list(CELL)).withColumn("e", F.when(~F.col("_miss"), left))
    return zscore(rows.select(*keys, "factor", "e"), "e")


def returns_at_month_ends(bars: DataFrame, n: int = 60) -> DataFrame:
    """entity, month_idx, returns: the n latest log returns at the entity's last bar of each month, newest first.

    NULL as a whole where there are too few bars or a price isn't positive. Each bar is dealt to the month ends that look
    back on it, so nothing after a month's end enters.
    """
    by = W.partitionBy("entity").orderBy("date")
    df = bars.select("entity", "date", F.row_number().over(by).alias("rn"), F.when((F.col("close") > 0) & (F.lag("close").over(by) > 0), F.log(F.col("close") / F.lag("close").over(by))).alias("r"), F.lead("date").over(by).alias("_next"))
    ends = df.filter(F.coalesce(F.trunc("_next", "month") != F.trunc("date", "month"), F.lit(True)))
    ends = ends.groupBy("entity").agg(F.collect_list(F.struct(F.col("rn").alias("end"), (F.year("date") * 12 + F.month("date")).alias("month_idx"))).alias("_ends"))
    dealt = df.join(ends, "entity").select("entity", "rn", "r", F.explode(F.filter("_ends", lambda m: m["end"].between(F.col("rn"), F.col("rn") + n - 1))).alias("_e"))
    rows = dealt.groupBy("entity", F.col("_e.month_idx").alias("month_idx")).agg(F.array_sort(F.collect_list(F.struct((F.col("_e.end") - F.col("rn")).alias("age"), "r"))).alias("x"))
    full = (F.size("x") == n) & F.forall("x", lambda v: v["r"].isNotNull())
    return rows.select("entity", "month_idx", F.when(full, F.transform("x", lambda v: v["r"])).alias("returns"))


def imputed(returns: DataFrame, n: int) -> DataFrame:
    """returns with the month's median of each place where a value, or the whole vector, is missing; a place without any value stays missing."""
    places = returns.select("month_idx", F.posexplode("returns").alias("i", "x")).groupBy("month_idx", "i").agg(F.median("x").alias("m"))
    medians = places.groupBy("month_idx").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("_m"))
    whole = F.coalesce("returns", F.array_repeat(F.lit(None).cast("double"), n))
    return returns.join(medians, "month_idx", "left").select("entity", "month_idx", F.transform(whole, lambda x, i: F.coalesce(x, F.try_element_at("_m", i))).alias("returns"))


def components_of(returns: DataFrame, components: int) -> DataFrame:
    """month_idx, mean, vectors, weights: the leading principal axes of a month's complete vectors, and the squared length of the scores on each.

    A month's rows stream through one task, which holds the sums and products of places (a square of the vector's
    length), never the rows.
    """

    def axes(month: int, n: int, total: np.ndarray, products: np.ndarray) -> dict:
        mean = total / n
        values, vectors = np.linalg.eigh(products - n * np.outer(mean, mean))
        keep = [k for k in range(len(values) - 1, -1, -1) if values[k] > 1e-10 * max(values[-1], 0.0)][: max(1, min(components, n - 1))]
        return {"month_idx": month, "mean": mean.tolist(), "vectors": [vectors[:, k].tolist() for k in keep], "weights": [float(values[k]) for k in keep]}

    def fold(parts):
        month, n, total, products = None, 0, None, None
        for part in parts:
            months = part.column("month_idx").to_numpy()
            x = part.column("returns").flatten().to_numpy().reshape(len(months), -1) if len(months) else np.zeros((0, 0))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(months)) + 1, [len(months)])) if len(months) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if month is not None and months[a] != month:
                    yield pa.RecordBatch.from_pylist([axes(month, n, total, products)], schema)
                    month = None
                if month is None:
                    month, n, total, products = int(months[a]), 0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
                n, total, products = n + int(b - a), total + x[a:b].sum(0), products + x[a:b].T @ x[a:b]
        if month is not None:
            yield pa.RecordBatch.from_pylist([axes(month, n, total, products)], schema)

    numbers = pa.list_(pa.float64())
    schema = pa.schema([("month_idx", pa.int32()), ("mean", numbers), ("vectors", pa.list_(numbers)), ("weights", numbers)])
    rows = returns.select(F.col("month_idx").cast("int").alias("month_idx"), "returns").repartition("month_idx").sortWithinPartitions("month_idx")
    return rows.mapInArrow(fold, "month_idx int, mean array<double>, vectors array<array<double>>, weights array<double>")


def neutralize_g(df: DataFrame, returns: DataFrame, components: int = 5, alignment: str = "drop", lookback: int = 60) -> DataFrame:
    """Rank-normalised factors less their projection on the leading principal components of the entities' return vectors.

    df: entity, month_idx, factor, y; returns: entity, month_idx, returns (see `returns_at_month_ends`). Entities
    without a complete vector keep NULL as residual and score, or with alignment "impute" take the month's medians. Ranks
    are among all entities; the scores of components have mean 0 and are orthogonal, so a factor's coefficient is one sum
    over their squared length. Missing values are 0 in the fit and come back as missing.
    """
    if alignment not in ("drop", "impute"):
        raise ValueError(f"unknown alignment {alignment!r}")
    if alignment == "impute":
        keys = df.select("entity", "month_idx").distinct()
        returns = imputed(keys.join(returns, ["entity", "month_idx"], "left"), lookback)
    returns = returns.filter(F.col("returns").isNotNull() & (F.size("returns") == lookback) & F.forall("returns", lambda x: x.isNotNull()))
    axes = components_of(returns, components)
    dot = lambda x, v: F.aggregate(F.zip_with(x, v, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    centred = F.zip_with("returns", "mean", lambda a, b: a - b)
    scores = returns.join(axes, "month_idx").withColumn("_c", centred).select("entity", "month_idx", F.transform("vectors", lambda v: dot(F.col("_c"), v)).alias("_p"), "weights")
    rows = rank_normal(df.withColumn("y", F.col("y").cast("double")), 2).withColumn("_miss", F.col("y").isNull()).withColumn("y", F.coalesce("y", F.lit(0.0)))
    rows = rows.join(scores, ["entity", "month_idx"], "left")
    known = F.col("_p").isNotNull()
    term = lambda k: F.when(known, F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)))
    square = lambda k: F.get("weights", F.lit(k))
    left = F.col("y") - F.avg(F.when(known, F.col("y"))).over(_cell())
    for k in range(components):
        left = left - F.coalesce(F.sum(term(k) * F.col("y")).over(_cell()) / square(k), F.lit(0.0)) * term(k)
    rows = rows.withColumn("e", F.when(known & ~F.col("_miss"), left)).drop("_p", "weights", "_miss")
    return zscore(rows, "e")


SCHEMES = {"a": neutralize_a, "b": neutralize_b, "d": neutralize_d, "e": neutralize_e, "b1": neutralize_b1, "b2": neutralize_b2, "f": neutralize_f, "g": neutralize_g}


def neutralize(df: DataFrame, scheme: str, *args, **options) -> DataFrame:
    """The scheme of that name on (month_idx, factor, entity, y, market_cap, industry): e is the residual, z its score."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}; known: {sorted(SCHEMES)}")
    exempt = F.col("factor").startswith("macro_") | F.col("factor").startswith("industry_relative_")
    if scheme == "d":
        exempt = exempt | F.col("factor").startswith("size_")
    done = SCHEMES[scheme](df.filter(~exempt), *args, **options)
    return done.unionByName(zscore(df.filter(exempt).withColumn("e", F.col("y")), "e"), allowMissingColumns=True)


def grouped_ic(df: DataFrame, least: int = 10) -> DataFrame:
    """Spearman correlation of y and target in each cell with `least` complete pairs or more."""
    df = df.filter("y is not null and target is not null")
    df = df.withColumns({"_ry": avg_rank("y", *CELL), "_rt": avg_rank("target", *CELL)})
    return df.groupBy(*CELL).agg(F.count("*").alias("n"), correlation("_ry", "_rt").alias("ic")).filter(F.col("n") >= least)


def icir(ics: DataFrame) -> DataFrame:
    """Mean IC over its population deviation, within +-5; 0 if the deviation is under 1e-4."""
    s = F.stddev_pop("ic")
    return ics.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), s.alias("std_ic"), F.when(s < 1e-4, 0.0).otherwise(clip(F.avg("ic") / s, -5.0, 5.0)).alias("icir"))


def earnings_on_book(roe: Column | str, revenue_growth: Column | str) -> Column:
    """Next year's earnings over book value: the return on equity, grown with revenue, both in per cent."""
    roe, growth = (F.col(c) if isinstance(c, str) else c for c in (roe, revenue_growth))
    return roe / 100 * (1 + growth / 100)


def misvaluation(df: DataFrame) -> DataFrame:
    """(g0 + g1 x) / pb - 1 within +-5 from the month's regression of pb on x; months with under 30 usable rows or no spread of x give NULL."""
    ok = (F.col("pb") > 0) & (F.abs("x") < 10)
    fit = df.filter(ok).groupBy("month_idx").agg(F.count("*").alias("_n"), F.regr_sxx("pb", "x").alias("_sxx"), F.regr_slope("pb", "x").alias("_g1"), F.regr_intercept("pb", "x").alias("_g0"))
    df = df.join(fit, "month_idx", "left")
    value = clip((F.col("_g0") + F.col("_g1") * F.col("x")) / F.col("pb") - 1, -5.0, 5.0)
    return df.withColumn("misvaluation", F.when(ok & (F.col("_n") >= 30) & (F.col("_sxx") >= 1e-10), value)).drop("_n", "_sxx", "_g0", "_g1")


def quantile_spread(df: DataFrame, q: int = 5, rows: int = 50, valid: int = 20) -> DataFrame:
    """Mean target of the top less the bottom quantile bin of y; edges interpolate linearly, bins are closed on the right, duplicate edges merge."""
    df = df.filter("y is not null and target is not null")
    edges = df.groupBy(*CELL).agg(F.count("*").alias("_n"), F.array_distinct(F.percentile("y", [i / q for i in range(q + 1)])).alias("_edges")).filter((F.col("_n") >= max(rows, valid)) & (F.size("_edges") > 2))
    df = df.join(edges, list(CELL))
    low, high = F.col("y") <= F.col("_edges")[1], F.col("y") > F.element_at("_edges", F.lit(-2))
    return df.groupBy(*CELL).agg((F.avg(F.when(high, F.col("target"))) - F.avg(F.when(low, F.col("target")))).alias("spread"))


def median_spread(df: DataFrame) -> DataFrame:
    """Mean target of the rows at or below the median of y less that of the rows above."""
    df = df.filter("y is not null and target is not null").withColumn("_m", F.median("y").over(_cell()))
    low = F.col("y") <= F.col("_m")
    return df.groupBy(*CELL).agg((F.avg(F.when(low, F.col("target"))) - F.avg(F.when(~low, F.col("target")))).alias("spread"))
