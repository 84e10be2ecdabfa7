"""Column expressions that Spark lacks: average-tie ranks, the inverse normal distribution, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The coefficients of algorithm AS 241 (Wichura 1988), numerators and denominators of its three ranges.
_NEAR = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3), (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_MIDDLE = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4), (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _horner(x, coefficients):
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c if not isinstance(out, float) else x * out + c
    return out


def inv_norm(p: Column) -> Column:
    """Quantile of the standard normal distribution, to full double precision."""
    q = p - 0.5
    near = 0.180625 - q * q
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle, far = tail - 1.6, tail - 5.0
    out = F.when(tail <= 5.0, _horner(middle, _MIDDLE[0]) / _horner(middle, _MIDDLE[1])).otherwise(_horner(far, _FAR[0]) / _horner(far, _FAR[1]))
    return F.when(F.abs(q) <= 0.425, q * _horner(near, _NEAR[0]) / _horner(near, _NEAR[1])).otherwise(F.signum(q) * out)


def inv_norm_sql(p: str) -> str:
    def horner(x: str, coefficients) -> str:
        out = repr(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = f"({out} * {x} + {c!r})"
        return out

    near, tail = f"(0.180625 - (({p}) - 0.5) * (({p}) - 0.5))", f"sqrt(-ln(least({p}, 1 - ({p}))))"
    middle, far = f"({tail} - 1.6)", f"({tail} - 5.0)"
    return (
        f"CASE WHEN abs(({p}) - 0.5) <= 0.425 THEN (({p}) - 0.5) * {horner(near, _NEAR[0])} / {horner(near, _NEAR[1])} "
        f"ELSE sign(({p}) - 0.5) * CASE WHEN {tail} <= 5.0 THEN {horner(middle, _MIDDLE[0])} / {horner(middle, _MIDDLE[1])} ELSE {horner(far, _FAR[0])} / {horner(far, _FAR[1])} END END"
    )


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within bounds; NULL stays NULL."""
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def avg_rank(x: str, *group: str) -> Column:
    """Rank from 1 with ties averaged among the group's non-NULL values; NULL stays NULL."""
    order = W.partitionBy(*group, F.col(x).isNull()).orderBy(x)  # one sort serves both
    ties = F.count("*").over(order.rangeBetween(W.currentRow, W.currentRow))
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def avg_rank_sql(x: str, *group: str) -> str:
    g = ", ".join(group)
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {g}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0 END"


def rank_pct(x: str, *group: str) -> Column:
    return avg_rank(x, *group) / F.count(x).over(W.partitionBy(*group))


def rank_pct_sql(x: str, *group: str) -> str:
    return f"({avg_rank_sql(x, *group)}) / count({x}) OVER (PARTITION BY {', '.join(group)})"


def correlation(a: str | Column, b: str | Column, window=None) -> Column:
    """Pearson correlation of complete pairs; NULL without spread, where the built-in one divides by zero."""
    over = (lambda c: c) if window is None else (lambda c: c.over(window))
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(over(F.covar_pop(a, b)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))
