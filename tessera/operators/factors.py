"""Rolling factors of entities over daily bars, evaluated at each entity's last bar of a month.

Each family yields (name, column, SQL): the Spark expression, and the same formula in SQL for the oracle. A factor over
w bars is NULL unless the entity has more than w bars. Changes run from the older to the newer day; convention
"reference" turns their sign.

Only running values (previous bars, totals so far) are windows over all bars. A frame is wanted at month ends alone, so
each bar is dealt to the month ends whose frames may hold it, with its age there, and every rolling measure is an
aggregate over the bars of young enough age: about a dozen rows a bar instead of a frame of up to 252 bars for each bar
and measure. All of it works on the entity's partition, so a family is one shuffle by entity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions
from pyspark.sql import Window as W

from tessera.functions.stats import correlation
from tessera.sources.tables import BARS_SQL


class _Nothing:
    """Stands for any column before a session exists, when only the SQL of a family is asked for."""

    def _same(self, *_, **__) -> _Nothing:
        return self

    __call__ = __getattr__ = __getitem__ = __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = _same
    __pow__ = __neg__ = __invert__ = __and__ = __rand__ = __or__ = __lt__ = __le__ = __gt__ = __ge__ = __eq__ = __ne__ = _same


class _Functions:
    def __getattr__(self, name: str):
        return getattr(functions, name) if SparkContext._active_spark_context else _Nothing()


F = _Functions()


def _by():
    return W.partitionBy("entity").orderBy("date") if SparkContext._active_spark_context else _Nothing()


_SQL = "PARTITION BY entity ORDER BY date"
YEAR = math.sqrt(252)
Factor = tuple[str, Column, str]


#: Aggregates that the family being built asks for, by name, and the greatest age it looks at.
_ASKED: ContextVar[dict] = ContextVar("asked")


def _ask(column: Column, oldest: int) -> Column:
    asked = _ASKED.get(None)
    if asked is None:  # only the SQL is wanted
        return column
    name = f"_a{len(asked)}"
    asked[name] = (column, oldest)
    return F.col(name)


def young(c: str | Column, n: int, skip: int = 0) -> Column:
    """c in bars of age skip to n - 1, NULL in others."""
    age = F.col("_age")
    return F.when((age >= skip) & (age < n), F.col(c) if isinstance(c, str) else c)


def sover(n: int) -> str:
    return f"OVER ({_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(c: str, n: int) -> Column:
    return _ask(F.max(young(c, n + 1, n)), n)


def slag(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({_SQL})"


def roll(name: str, c: str | Column, n: int, skip: int = 0) -> Column:
    return _ask(getattr(F, name)(young(c, n, skip)), n - 1)


def listed(c: str, n: int) -> Column:
    """The frame's values from the oldest to the newest."""
    aged = F.array_sort(F.collect_list(F.when(F.col("_age") < n, F.struct((-F.col("_age")).alias("at"), F.col(c).alias("x")))))
    return _ask(F.filter(F.transform(aged, lambda v: v["x"]), lambda x: x.isNotNull()), n - 1)


def sroll(name: str, c: str, n: int) -> str:
    return f"{name}({c}) {sover(n)}"


def _corr(a: str, b: str, n: int) -> Column:
    return _ask(correlation(young(a, n), young(b, n)), n - 1) if SparkContext._active_spark_context else _Nothing()


def rule(name: str, w: int, column: Column, sql: str) -> Factor:
    return name, F.when(F.col("rn") > w, column), f"CASE WHEN rn > {w} THEN {sql} END"


def _prev(c: str, n: int) -> Column:
    return F.lag(c, n).over(_by())


def base(bars: DataFrame, convention: str = "chronological") -> DataFrame:
    sign = -1.0 if convention == "reference" else 1.0
    df = bars.withColumns({"rn": F.row_number().over(_by()), "r": sign * F.log(F.col("close") / _prev("close", 1)), "dc": sign * (F.col("close") - _prev("close", 1)), "pc": _prev("close", 1), "month_end": F.coalesce(F.trunc(F.lead("date").over(_by()), "month") != F.trunc("date", "month"), F.lit(True))})
    return df.withColumns({
        "up": F.greatest("dc", F.lit(0.0)), "down": F.greatest(-F.col("dc"), F.lit(0.0)), "dv": F.col("volume") - _prev("volume", 1),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))),
        "hl2": F.pow(F.log(F.col("high") / F.col("low")), 2), "co2": F.pow(F.log(F.col("close") / F.col("open")), 2), "tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
        "rs1": F.log(F.col("high") / F.col("close")) * F.log(F.col("high") / F.col("open")) + F.log(F.col("low") / F.col("close")) * F.log(F.col("low") / F.col("open")),
        "illiq": F.abs("r") / (_prev("amount", 1) + 1e-8),
        "pdm": F.when((F.col("high") - _prev("high", 1) > _prev("low", 1) - F.col("low")) & (F.col("high") > _prev("high", 1)), F.col("high") - _prev("high", 1)).otherwise(0.0),
        "mdm": F.when((_prev("low", 1) - F.col("low") > F.col("high") - _prev("high", 1)) & (_prev("low", 1) > F.col("low")), _prev("low", 1) - F.col("low")).otherwise(0.0),
        "on": F.log(F.col("open") / F.col("pc")), "oc2": 0.5 * (F.pow(F.log(F.col("high") / F.col("open")), 2) + F.pow(F.log(F.col("low") / F.col("open")), 2)),
        "sv": F.signum("dc") * F.col("volume"), "obv": F.sum(F.signum("dc") * F.col("volume")).over(_by()),
    })


BASE_SQL = f"""WITH {BARS_SQL},
b0 AS (SELECT *, row_number() OVER ({_SQL}) AS rn, ln(close / {slag("close", 1)}) AS r, close - {slag("close", 1)} AS dc, {slag("close", 1)} AS pc,
  coalesce(date_trunc('month', lead(date) OVER ({_SQL})) <> date_trunc('month', date), true) AS month_end,
  {slag("high", 1)} AS ph, {slag("low", 1)} AS pl, {slag("amount", 1)} AS pa, volume - {slag("volume", 1)} AS dv FROM bars),
b AS (SELECT *, greatest(dc, 0.0) AS up, greatest(-dc, 0.0) AS down,
  CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  pow(ln(high / low), 2) AS hl2, pow(ln(close / open), 2) AS co2, (high + low + close) / 3 AS tp,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs1, abs(r) / (pa + 1e-8) AS illiq,
  CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0.0 END AS pdm, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0.0 END AS mdm,
  ln(open / pc) AS o_n, 0.5 * (pow(ln(high / open), 2) + pow(ln(low / open), 2)) AS oc2, sign(dc) * volume AS sv FROM b0)"""


def _ratio(c: str, w: int) -> tuple[Column, str]:
    return F.col(c) / lag(c, w) - 1, f"{c} / {slag(c, w)} - 1"


def _std(c: str, n: int) -> tuple[Column, str]:
    return roll("stddev_pop", c, n), sroll("stddev_pop", c, n)


def _mean(c: str, n: int) -> tuple[Column, str]:
    return roll("avg", c, n), sroll("avg", c, n)


def _sharpe(w: int) -> tuple[Column, str]:
    (m, sm), (s, ss) = _mean("r", w - 1), _std("r", w - 1)
    return F.when(s > 1e-8, m / s * YEAR), f"CASE WHEN {ss} > 1e-8 THEN {sm} / ({ss}) * {YEAR!r} END"


def _rsi(w: int) -> tuple[Column, str]:
    g, d = roll("avg", "up", w), roll("avg", "down", w)
    sg, sd = sroll("avg", "up", w), sroll("avg", "down", w)
    return F.when(d > 0, 100 - 100 / (1 + g / d)).when(g > 0, 100.0).otherwise(50.0), f"CASE WHEN {sd} > 0 THEN 100 - 100 / (1 + {sg} / ({sd})) WHEN {sg} > 0 THEN 100.0 ELSE 50.0 END"


def _place(w: int, flat: float, scale: float = 1.0, top: bool = False) -> tuple[Column, str]:
    hi, lo = roll("max", "high", w), roll("min", "low", w)
    shi, slo = sroll("max", "high", w), sroll("min", "low", w)
    up, sup = (hi - F.col("close"), f"({shi} - close)") if top else (F.col("close") - lo, f"(close - {slo})")
    return F.when(hi > lo, up / (hi - lo) * scale).otherwise(flat), f"CASE WHEN {shi} > {slo} THEN {sup} / ({shi} - {slo}) * {scale!r} ELSE {flat!r} END"


def momentum() -> Iterator[Factor]:
    for w in (5, 10, 20, 40, 60, 90, 120, 180, 240):
        yield rule(f"momentum_return_{w}d", w, *_ratio("close", w))
    for k, w in ((1, 20), (3, 60), (6, 120), (12, 240)):
        yield rule(f"momentum_ret_{k}m", w, *_ratio("close", w))
    for w in (5, 10):
        yield rule(f"momentum_reversal_{w}d", w, *_ratio("close", w))
    (r20, s20), (r60, s60), (r120, s120), (r240, s240) = (_ratio("close", w) for w in (20, 60, 120, 240))
    yield rule("momentum_medium_60d", 60, r60, s60)
    yield rule("momentum_acceleration", 60, r20 - r60 / 3, f"({s20}) - ({s60}) / 3")
    yield rule("momentum_long_240d", 240, r240, s240)
    yield rule("momentum_mean_reversion", 240, -r240, f"-({s240})")
    for w in (20, 60, 120, 240):
        yield rule(f"momentum_sharpe_{w}d", w, *_sharpe(w))
        yield rule(f"momentum_log_return_{w}d", w, F.log(F.col("close") / lag("close", w)), f"ln(close / {slag('close', w)})")
    for w in (6, 14, 20, 30):
        yield rule(f"momentum_rsi_{w}d", w, *_rsi(w))
    for w in (10, 20, 60, 120):
        yield rule(f"momentum_price_position_{w}d", w, *_place(w, 0.5))
    yield rule("momentum_score", 120, 0.5 * r20 + 0.3 * r60 + 0.2 * r120, f"0.5 * ({s20}) + 0.3 * ({s60}) + 0.2 * ({s120})")
    for w in (5, 10, 20, 60):
        new, old = F.col("close") / lag("close", w) - 1, lag("close", w) / lag("close", 2 * w) - 1
        yield rule(f"momentum_change_{w}d", 2 * w, F.when(old != 0, new / old - 1), f"CASE WHEN {slag('close', w)} <> {slag('close', 2 * w)} THEN (close / {slag('close', w)} - 1) / ({slag('close', w)} / {slag('close', 2 * w)} - 1) - 1 END")


def momentum_paths() -> Iterator[Factor]:
    """Factors that look at each return of the frame, as arrays; weights fall by age with a third of the frame."""
    for w in (20, 60, 120, 240):
        weights = [math.exp(-i / (w / 3)) for i in reversed(range(w))]
        total = sum(weights)
        arr = listed("r", w)
        sd = roll("stddev_pop", "r", w)
        dot = F.aggregate(F.zip_with(arr, F.array(*[F.lit(x) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        yield rule(f"momentum_weighted_{w}d", w, dot / total, f"list_sum(list_transform(generate_series(1, {w}), lambda i: coalesce(arr{w}[i], 0) * {weights!r}[i])) / {total!r}")
        yield rule(f"momentum_consistency_{w}d", w, roll("avg", (F.col("r") > 0).cast("double"), w), sroll("avg", "CAST(r > 0 AS DOUBLE)", w))
        yield rule(f"momentum_extreme_count_{w}d", w, F.size(F.filter(arr, lambda x: F.abs(x) > 2 * sd)) / float(w), f"len(list_filter(arr{w}, lambda x: abs(x) > 2 * sd{w})) / {float(w)!r}")


def volatility() -> Iterator[Factor]:
    for w in (5, 10, 20, 40, 60, 90, 120, 240):
        s, ss = _std("r", w)
        yield rule(f"volatility_hist_{w}d", w, s * YEAR, f"{ss} * {YEAR!r}")
    for w in (20, 60, 120, 240):
        m, sm = _mean("hl2", w)
        yield rule(f"volatility_parkinson_{w}d", w, F.sqrt(m / (4 * math.log(2))) * YEAR, f"sqrt({sm} / {4 * math.log(2)!r}) * {YEAR!r}")
    for w in (14, 20):
        m, sm = _mean("tr", w)
        yield rule(f"volatility_atr_{w}d", w, m / F.col("close"), f"{sm} / close")
    m1, m2, m3, m4 = (roll("avg", F.pow("r", k), 60) for k in (1, 2, 3, 4))
    q1, q2, q3, q4 = (sroll("avg", f"pow(r, {k})", 60) for k in (1, 2, 3, 4))
    yield rule("volatility_skew_60d", 60, roll("skewness", "r", 60), f"(({q3}) - 3 * ({q1}) * ({q2}) + 2 * pow({q1}, 3)) / pow(({q2}) - pow({q1}, 2), 1.5)")
    yield rule("volatility_kurt_60d", 60, roll("kurtosis", "r", 60), sroll("kurtosis_pop", "r", 60))
    for w in (20, 60):
        h, sh = _mean("hl2", w)
        c, sc = _mean("co2", w)
        k = 2 * math.log(2) - 1
        yield rule(f"volatility_gk_{w}d", w, F.sqrt(F.greatest(0.5 * h - k * c, F.lit(0.0))) * YEAR, f"sqrt(greatest(0.5 * ({sh}) - {k!r} * ({sc}), 0.0)) * {YEAR!r}")
        m, sm = _mean("rs1", w)
        yield rule(f"volatility_rs_{w}d", w, F.sqrt(F.greatest(m, F.lit(0.0))) * YEAR, f"sqrt(greatest({sm}, 0.0)) * {YEAR!r}")
        v, m = roll("var_pop", "on", w - 1), roll("avg", "oc2", w)
        yield rule(f"volatility_yz_{w}d", w, F.sqrt(v + m) * YEAR, f"sqrt({sroll('var_pop', 'o_n', w - 1)} + {sroll('avg', 'oc2', w)}) * {YEAR!r}")
    low = F.when(F.col("r") < 0, F.col("r"))
    yield rule("volatility_downside_60d", 60, F.when(roll("count", low, 60) >= 2, roll("stddev_pop", low, 60) * YEAR).otherwise(0.0), f"CASE WHEN {sroll('count', 'CASE WHEN r < 0 THEN r END', 60)} >= 2 THEN {sroll('stddev_pop', 'CASE WHEN r < 0 THEN r END', 60)} * {YEAR!r} ELSE 0.0 END")
    (s60, q60), (s120, q120) = _std("r", 60), _std("r", 120)
    yield rule("volatility_mean_reversion", 120, F.when(s120 > 1e-8, s60 / s120 - 1), f"CASE WHEN {q120} > 1e-8 THEN {q60} / ({q120}) - 1 END")


def technical() -> Iterator[Factor]:
    for w in (5, 10, 20, 60, 120, 240):
        yield rule(f"technical_ma_{w}d", w, *_mean("close", w))
    for w in (5, 10, 20, 60):
        m, sm = _mean("close", w)
        yield rule(f"technical_price_ma_ratio_{w}d", w, F.col("close") / m, f"close / ({sm})")
        yield rule(f"technical_volume_ma_{w}d", w, *_mean("volume", w))
        yield rule(f"technical_pv_corr_{w}d", w, _corr("close", "volume", w), f"corr(close, volume) {sover(w)}")
    for w in (9, 14, 20, 30):
        yield rule(f"technical_kdj_rsv_{w}d", w, *_place(w, 50.0, 100.0))
    for w in (20, 60):
        (m, sm), (s, ss) = _mean("close", w), _std("close", w)
        yield rule(f"technical_boll_width_{w}d", w, 4 * s / m, f"4 * ({ss}) / ({sm})")
        yield rule(f"technical_boll_pos_{w}d", w, F.when(s > 1e-8, (F.col("close") - m) / (2 * s)).otherwise(0.0), f"CASE WHEN {ss} > 1e-8 THEN (close - {sm}) / (2 * ({ss})) ELSE 0.0 END")
    yield "technical_obv", F.col("obv"), f"sum(sv) OVER ({_SQL})"
    for w in (10, 20, 60, 120):
        yield rule(f"technical_willr_{w}d", w, *_place(w, -50.0, -100.0, top=True))
        yield rule(f"technical_momentum_{w}d", w, F.col("close") - lag("close", w), f"close - {slag('close', w)}")
        yield rule(f"technical_roc_{w}d", w, (F.col("close") / lag("close", w) - 1) * 100, f"(close / {slag('close', w)} - 1) * 100")
    for w in (14, 20):
        t, st = roll("sum", "tr", w), sroll("sum", "tr", w)
        for side, c in (("plus", "pdm"), ("minus", "mdm")):
            yield rule(f"technical_{side}_di_{w}d", w, F.when(t > 0, roll("sum", c, w) / t * 100), f"CASE WHEN {st} > 0 THEN {sroll('sum', c, w)} / ({st}) * 100 END")


def liquidity() -> Iterator[Factor]:
    for w in (5, 10, 20):
        for c in ("volume", "turnover", "amount"):
            yield rule(f"liquidity_avg_{c}_{w}d", w, *_mean(c, w))
        (m, sm) = _mean("volume", w)
        old, sold = roll("avg", "volume", 2 * w, w), f"avg(volume) OVER ({_SQL} ROWS BETWEEN {2 * w - 1} PRECEDING AND {w} PRECEDING)"
        yield rule(f"liquidity_volume_change_{w}d", 2 * w, m / old - 1, f"{sm} / ({sold}) - 1")
    for w in (5, 10, 20, 60):
        m, sm = _mean("illiq", w)
        yield rule(f"liquidity_amihud_{w}d", w, m, sm)
    past, spast = roll("avg", "volume", 21, 1), f"avg(volume) OVER ({_SQL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    yield rule("liquidity_shock_volume", 20, F.col("volume") / past - 1, f"volume / ({spast}) - 1")
    yield rule("liquidity_shock_corr_20d", 20, _corr("r", "dv", 20), f"corr(r, dv) {sover(20)}")


def alpha() -> Iterator[Factor]:
    first = lag("r", 19)
    yield rule("alpha_001", 20, F.when(first < 0, roll("stddev_pop", "r", 20)).otherwise(F.col("close")), f"CASE WHEN first_value(r) {sover(20)} < 0 THEN {sroll('stddev_pop', 'r', 20)} ELSE close END")
    yield rule("alpha_002", 1, -F.col("r"), "-r")
    yield rule("alpha_003", 10, -_corr("close", "volume", 10), f"-corr(close, volume) {sover(10)}")
    closes = listed("close", 9)
    yield rule("alpha_004", 9, -F.size(F.filter(closes, lambda x: x <= F.col("close"))) / 9.0, f"-len(list_filter(list(close) {sover(9)}, lambda x: x <= close)) / 9.0")
    yield rule("alpha_005", 10, F.col("open") - roll("sum", F.least("close", "open"), 10), f"open - {sroll('sum', 'least(close, open)', 10)}")
    d7 = F.col("close") - lag("close", 7)
    yield rule("alpha_006", 7, -F.signum(d7) * (1 + d7 / lag("close", 7)), f"-sign(close - {slag('close', 7)}) * (1 + (close - {slag('close', 7)}) / {slag('close', 7)})")
    (m, sm), (s, ss), (v, sv) = _mean("close", 10), _std("close", 20), _mean("volume", 10)
    yield rule("alpha_mean10_gap", 10, m - F.col("close"), f"{sm} - close")
    yield rule("alpha_std20_rel", 20, s / F.col("close"), f"{ss} / close")
    yield rule("alpha_volume10_rel", 10, v / F.col("volume") - 1, f"{sv} / volume - 1")
    yield rule("alpha_range_rel", 1, (F.col("high") - F.col("low")) / F.col("close"), "(high - low) / close")


def stats() -> Iterator[Factor]:
    """Rolling statistics, sentiment, and short composite families."""
    for w in (20, 60):
        for name in ("max", "min", "avg"):
            yield rule(f"roll_{name}_close_{w}d", w, roll(name, "close", w), sroll(name, "close", w))
        yield rule(f"roll_std_r_{w}d", w, *_std("r", w))
        yield rule(f"roll_mean_volume_{w}d", w, *_mean("volume", w))
        yield rule(f"roll_std_volume_{w}d", w, *_std("volume", w))
    yield rule("sent_daily_return", 1, F.exp("r") - 1, "exp(r) - 1")
    for c in ("open", "close"):
        yield f"sent_{c}_position", F.when(F.col("high") > F.col("low"), (F.col(c) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5), f"CASE WHEN high > low THEN ({c} - low) / (high - low) ELSE 0.5 END"
    yield rule("sent_pv_sign", 1, F.signum("dc") * F.signum("dv"), "sign(dc) * sign(dv)")
    yield rule("jq_share_up_20d", 20, roll("avg", (F.col("r") > 0).cast("double"), 20), sroll("avg", "CAST(r > 0 AS DOUBLE)", 20))
    for w in (20, 60):
        hi, lo = roll("max", "close", w), roll("min", "close", w)
        yield rule(f"jq_price_position_{w}d", w, (F.col("close") - lo) / (hi - lo + 1e-8), f"(close - {sroll('min', 'close', w)}) / ({sroll('max', 'close', w)} - {sroll('min', 'close', w)} + 1e-8)")
    m, sm = _mean("close", 20)
    yield rule("jq_ma_deviation_20d", 20, F.col("close") / m - 1, f"close / ({sm}) - 1")
    m, sm = _mean("volume", 20)
    yield rule("jq_volume_ratio_20d", 20, F.col("volume") / m - 1, f"volume / ({sm}) - 1")
    yield rule("barra_beta_60d", 60, roll("stddev_pop", "r", 59) * YEAR, f"{sroll('stddev_pop', 'r', 59)} * {YEAR!r}")
    yield rule("barra_liquidity", 20, *_mean("volume", 20))
    yield rule("barra_momentum_252d", 252, F.log(F.col("close") / lag("close", 252)), f"ln(close / {slag('close', 252)})")
    (r20, q20), (s20, t20) = _ratio("close", 20), _std("r", 20)
    yield rule("deriv_mom_vol", 20, F.when(s20 > 1e-8, r20 / s20), f"CASE WHEN {t20} > 1e-8 THEN ({q20}) / ({t20}) END")
    yield rule("reversal_20d", 20, -r20, f"-({q20})")


def supplement() -> Iterator[Factor]:
    for w in (20, 60, 120):
        up, dn = roll("sum", F.greatest("r", F.lit(0.0)), w), roll("sum", F.greatest(-F.col("r"), F.lit(0.0)), w)
        yield rule(f"sup_mom_strength_{w}d", w, F.when(dn > 1e-8, up / dn), f"CASE WHEN {sroll('sum', 'greatest(-r, 0.0)', w)} > 1e-8 THEN {sroll('sum', 'greatest(r, 0.0)', w)} / ({sroll('sum', 'greatest(-r, 0.0)', w)}) END")
    (r20, q20), (r240, q240) = _ratio("close", 20), _ratio("close", 240)
    yield rule("sup_mom_jt_12_1", 240, r240 - r20, f"({q240}) - ({q20})")
    ln = lambda a, b: F.log(lag("close", a) / lag("close", b)) if a else F.log(F.col("close") / lag("close", b))
    yield rule("sup_mom_accel", 60, ln(0, 20) - ln(20, 60), f"ln(close / {slag('close', 20)}) - ln({slag('close', 20)} / {slag('close', 60)})")
    for w in (5, 20):
        yield rule(f"sup_pv_momentum_{w}d", w, roll("sum", F.col("r") * F.col("volume"), w) / roll("sum", "volume", w), f"{sroll('sum', 'r * volume', w)} / ({sroll('sum', 'volume', w)})")
    for a, b in ((5, 20), (20, 60)):
        (m, sm), (n, sn) = _mean("close", a), _mean("close", b)
        yield rule(f"sup_tech_ma_cross_{a}_{b}", b, m / n - 1, f"{sm} / ({sn}) - 1")
    for w in (14, 28):  # bars since the latest extreme
        highs, lows = listed("high", w), listed("low", w)
        up = (F.array_position(highs, F.array_max(highs))).cast("double") / w * 100
        down = (F.array_position(lows, F.array_min(lows))).cast("double") / w * 100
        sup, sdown = f"list_position(list(high) {sover(w)}, max(high) {sover(w)}) / {float(w)!r} * 100", f"list_position(list(low) {sover(w)}, min(low) {sover(w)}) / {float(w)!r} * 100"
        yield rule(f"sup_aroon_up_{w}d", w, up, sup)
        yield rule(f"sup_aroon_down_{w}d", w, down, sdown)
        yield rule(f"sup_aroon_osc_{w}d", w, up - down, f"{sup} - {sdown}")
    for w in (20, 60):
        var = _ask(F.percentile(young("r", w), 0.05), w - 1)
        yield rule(f"sup_var5_{w}d", w, var, f"quantile_cont(r, 0.05) {sover(w)}")
        yield rule(f"sup_kurt_{w}d", w, roll("kurtosis", "r", w), sroll("kurtosis_pop", "r", w))
    for w in (5, 10, 20):
        (m, sm), (s, ss) = _mean("volume", w), _std("volume", w)
        yield rule(f"sup_volume_cv_{w}d", w, s / m, f"{ss} / ({sm})")
    low = F.when(F.col("r") < 0, F.col("r"))
    m, d = roll("avg", "r", 60), roll("stddev_pop", low, 60)
    yield rule("sup_sortino_60d", 60, F.when(d > 1e-8, m / d * YEAR), f"CASE WHEN {sroll('stddev_pop', 'CASE WHEN r < 0 THEN r END', 60)} > 1e-8 THEN {sroll('avg', 'r', 60)} / ({sroll('stddev_pop', 'CASE WHEN r < 0 THEN r END', 60)}) * {YEAR!r} END")


def _worst_fall(w: int) -> Column:
    """The deepest fall from the running maximum of the frame's closes, as a share."""
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("fall"))

    def step(acc: Column, x: Column) -> Column:
        top = F.greatest(acc["top"], x)
        return F.struct(top.alias("top"), F.greatest(acc["fall"], 1 - x / top).alias("fall"))

    return F.aggregate(listed("close", w), start, step)["fall"]


def risk() -> Iterator[Factor]:
    """Risk, shocks and shapes of returns."""
    for w in (6, 14, 24):
        yield rule(f"sup_tech_rsi_{w}", w, *_rsi(w))
    low, slow = F.when(F.col("r") < 0, F.col("r")), "CASE WHEN r < 0 THEN r END"
    for w in (20, 60):
        yield rule(f"sup_mom_relative_{w}d", w, F.log(F.col("close") / lag("close", w)), f"ln(close / {slag('close', w)})")
        yield rule(f"sup_risk_downside_{w}d", w, F.coalesce(roll("stddev_pop", low, w) * YEAR, F.lit(0.0)), f"coalesce({sroll('stddev_pop', slow, w)} * {YEAR!r}, 0.0)")
        var, r = _ask(F.percentile(young("r", w), 0.05), w - 1), listed("r", w)
        tail = F.filter(r, lambda x: x <= var)  # noqa: B023
        yield rule(f"sup_risk_cvar_{w}d", w, F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail), f"CASE WHEN month_end THEN list_avg(list_filter(rl{w}, lambda x: x <= v{w})) END")
        s, ss = _std("r", w)
        yield rule(f"sup_ret_skew_{w}d", w, F.when(s > 1e-8, roll("skewness", "r", w)), f"CASE WHEN {ss} > 1e-8 THEN ({sroll('avg', 'pow(r, 3)', w)} - 3 * {sroll('avg', 'r', w)} * {sroll('avg', 'pow(r, 2)', w)} + 2 * pow({sroll('avg', 'r', w)}, 3)) / pow({ss}, 3) END")
        old, sold = roll("stddev_pop", "r", 2 * w, w), f"stddev_pop(r) OVER ({_SQL} ROWS BETWEEN {2 * w - 1} PRECEDING AND {w} PRECEDING)"
        yield rule(f"volatility_change_{w}d", 2 * w, F.when(old > 1e-8, s / old - 1), f"CASE WHEN {sold} > 1e-8 THEN {ss} / ({sold}) - 1 END")
    for w in (60, 120):
        yield rule(f"sup_risk_max_dd_{w}d", w, _worst_fall(w), _FALL.format(w=w))
    for w in (5, 10, 20):
        m, sm = _mean("amount", w)
        yield rule(f"sup_liq_amount_shock_{w}d", w, F.col("amount") / m - 1, f"amount / ({sm}) - 1")
    for w in (5, 10, 20, 60):
        hi, lo = roll("max", "close", w), roll("min", "close", w)
        shi, slo = sroll("max", "close", w), sroll("min", "close", w)
        yield rule(f"sup_price_pos_{w}d", w, F.when(hi > lo, (F.col("close") - lo) / (hi - lo)).otherwise(0.5), f"CASE WHEN {shi} > {slo} THEN (close - {slo}) / ({shi} - {slo}) ELSE 0.5 END")
    (s20, q20), (s40, q40) = _std("r", 20), _std("r", 40)
    yield rule("sup_vol_change", 40, F.when(s40 > 1e-8, s20 / s40 - 1), f"CASE WHEN {q40} > 1e-8 THEN {q20} / ({q40}) - 1 END")
    (m, sm), (s, ss) = _mean("r", 60), _std("r", 60)
    yield rule("sup_sharpe_60d", 60, F.when(s > 1e-8, m / s * YEAR), f"CASE WHEN {ss} > 1e-8 THEN {sm} / ({ss}) * {YEAR!r} END")
    (r, sr), fall = _ratio("close", 120), _worst_fall(120)
    yield rule("sup_calmar_120d", 120, F.when(fall > 1e-8, r / fall), f"CASE WHEN {_FALL.format(w=120)} > 1e-8 THEN ({sr}) / ({_FALL.format(w=120)}) END")


_FALL = "CASE WHEN month_end THEN list_max(list_transform(generate_series(1, len(cl{w})), lambda i: 1 - cl{w}[i] / list_max(cl{w}[1:i]))) END"


def composite() -> Iterator[Factor]:
    """Families that combine other factors, and the commodity channel index."""
    for w in (5, 10, 20, 60, 120):
        yield rule(f"jq_momentum_{w}d", w, *_ratio("close", w))
        s, ss = _std("r", w)
        yield rule(f"jq_volatility_{w}d", w, s * YEAR, f"{ss} * {YEAR!r}")
        yield rule(f"jq_turnover_{w}d", w, *_mean("turnover", w))
    yield rule("jq_range_20d", 20, (roll("max", "high", 20) - roll("min", "low", 20)) / F.col("close"), f"({sroll('max', 'high', 20)} - {sroll('min', 'low', 20)}) / close")
    (r20, q20), (r60, q60), (r120, q120) = (_ratio("close", w) for w in (20, 60, 120))
    yield rule("reversal_60d", 60, -r60, f"-({q60})")
    s, ss = _std("r", 60)
    vol, svol = s * YEAR, f"({ss} * {YEAR!r})"
    yield rule("deriv_mom_vol_ratio", 60, F.when(vol > 1e-8, r60 / vol), f"CASE WHEN {svol} > 1e-8 THEN ({q60}) / {svol} END")
    rsi, srsi = _rsi(14)
    yield rule("deriv_rsi_adjusted_mom", 60, r60 * (rsi - 50) / 50, f"({q60}) * (({srsi}) - 50) / 50")
    yield rule("deriv_vol_adjusted_return", 60, F.when(vol > 0, r60 / (vol + 0.01)), f"CASE WHEN {svol} > 0 THEN ({q60}) / ({svol} + 0.01) END")
    agree = lambda x: (F.signum(x) == F.signum(r20)).cast("double")
    yield rule("deriv_momentum_consistency", 120, (1 + agree(r60) + agree(r120)) / 3, f"(1 + CAST(sign({q60}) = sign({q20}) AS DOUBLE) + CAST(sign({q120}) = sign({q20}) AS DOUBLE)) / 3")
    yield rule("deriv_risk_adjusted_mom", 60, *_sharpe(60))
    for w in (10, 20, 60, 120):
        typical, (m, sm) = listed("tp", w), _mean("tp", w)
        spread = F.aggregate(F.transform(typical, lambda x: F.abs(x - m)), F.lit(0.0), lambda a, x: a + x) / w  # noqa: B023
        own = (F.col("high") + F.col("low") + F.col("close")) / 3
        dev = f"list_avg(list_transform(tl{w}, lambda x: abs(x - tm{w})))"
        yield rule(f"technical_cci_{w}d", w, F.when(spread > 1e-8, (own - m) / (0.015 * spread)).otherwise(0.0), f"CASE WHEN NOT month_end THEN NULL WHEN {dev} > 1e-8 THEN (tp - tm{w}) / (0.015 * {dev}) ELSE 0.0 END")


#: Columns that the SQL of a family refers to.
_MORE = {
    "momentum_paths": ", ".join(f"stddev_pop(r) {sover(w)} AS sd{w}, list(r) {sover(w)} AS arr{w}" for w in (20, 60, 120, 240)),
    "risk": ", ".join([*(f"list(r) {sover(w)} AS rl{w}, quantile_cont(r, 0.05) {sover(w)} AS v{w}" for w in (20, 60)), *(f"list(close) {sover(w)} AS cl{w}" for w in (60, 120))]),
    "composite": ", ".join(f"list(tp) {sover(w)} AS tl{w}, avg(tp) {sover(w)} AS tm{w}" for w in (10, 20, 60, 120)),
}
FAMILIES = {"momentum": momentum, "momentum_paths": momentum_paths, "volatility": volatility, "technical": technical, "liquidity": liquidity, "alpha": alpha, "stats": stats, "supplement": supplement, "risk": risk, "composite": composite}


def minimum() -> Iterator[Factor]:
    yield rule("momentum_return_20d", 20, *_ratio("close", 20))
    yield rule("ma_20", 20, *_mean("close", 20))
    s, ss = _std("r", 20)
    yield rule("hist_vol_20", 20, s * YEAR, f"{ss} * {YEAR!r}")


def style() -> Iterator[Factor]:
    """Style columns of the neutralisation by style blocks, further factors to neutralise, and the close."""
    for w in (20, 60, 120, 5):
        yield rule(f"momentum_return_{w}d", w, *_ratio("close", w))
    for w in (20, 60, 10):
        s, ss = _std("r", w)
        yield rule(f"volatility_hist_{w}d", w, s * YEAR, f"{ss} * {YEAR!r}")
    for name, w in (("liquidity_avg_turnover_20d", 20), ("jq_turnover_60d", 60), ("liquidity_avg_turnover_5d", 5)):
        yield rule(name, w, *_mean("turnover", w))
    yield rule("momentum_rsi_14d", 14, *_rsi(14))
    yield rule("momentum_price_position_20d", 20, *_place(20, 0.5))
    yield rule("close", 0, F.col("close"), "close")


#: Families that serve other operators; not registered on their own.
_INNER = {"minimum": minimum, "style": style}

#: Columns of the month end's own bar that formulas refer to.
_OWN = ("rn", "open", "high", "low", "close", "volume", "amount", "r", "dc", "dv", "obv")
#: Decimals of results, where it isn't 6: values far below 1.
FINE = {f"liquidity_amihud_{w}d": 12 for w in (5, 10, 20, 60)}


def family(bars: DataFrame, name: str, convention: str = "chronological", month_ends: bool = True) -> DataFrame:
    """entity, date and the factors of a family at month ends (or at every bar)."""
    df = base(bars, convention)
    asked: dict[str, tuple[Column, int]] = {}
    token = _ASKED.set(asked)
    try:
        found = list((_INNER.get(name) or FAMILIES[name])())
    finally:
        _ASKED.reset(token)
    oldest = max((n for _, n in asked.values()), default=0)
    at = (df.filter("month_end") if month_ends else df).groupBy("entity").agg(F.collect_list(F.struct(F.col("rn").alias("end"), F.col("date").alias("at"))).alias("_ends"))
    dealt = df.join(at, "entity").withColumn("_e", F.explode(F.filter("_ends", lambda m: m["end"].between(F.col("rn"), F.col("rn") + oldest)))).drop("_ends")
    dealt = dealt.withColumn("_age", F.col("_e.end") - F.col("rn"))
    own = [F.max(F.when(F.col("_age") == 0, F.col(c))).alias(c) for c in _OWN]
    rows = dealt.groupBy("entity", F.col("_e.at").alias("date")).agg(*own, *[c.alias(k) for k, (c, _) in asked.items()])
    rows = rows.select("entity", "date", *[c.alias(n) for n, c, _ in found])
    return rows.select("entity", "date", *[F.round(n, FINE.get(n, 6)).alias(n) for n, _, _ in found])


def family_sql(name: str) -> str:
    found = list((_INNER.get(name) or FAMILIES[name])())
    more = _MORE.get(name, "1 AS one")
    inner = ", ".join(f"{sql} AS {n}" for n, _, sql in found)
    outer = ", ".join(f"round({n}, {FINE.get(n, 6)}) AS {n}" for n, _, _ in found)
    return f"{BASE_SQL}, b1 AS (SELECT *, {more} FROM b), x AS (SELECT entity, date, month_end, {inner} FROM b1) SELECT entity, date, {outer} FROM x WHERE month_end"


#: Bars of a block of the recursive averages: the powers of a decay over so many bars stay far within doubles.
BLOCK = 256


def recursive_averages(rows: DataFrame, asked: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds to rows (entity, rn from 1 on, ...) each asked name: (column, span): e = value at first, then e + (value - e) * 2 / (span + 1).

    Within a block the average that starts from 0 is a running sum of values weighed by powers of the decay. What comes
    from the blocks before is one number a block, carried on by a fold over an entity's blocks; so the work is linear in
    bars, and an entity's bars are dealt to as many tasks as it has blocks. Values must not be NULL.
    """
    rows = rows.withColumn("_b", F.floor((F.col("rn") - 1) / BLOCK)).withColumn("_j", ((F.col("rn") - 1) % BLOCK).cast("double"))
    upto = W.partitionBy("entity", "_b").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    own, decay = {}, {name: 1 - 2.0 / (span + 1) for name, (_, span) in asked.items()}
    for name, (column, span) in asked.items():
        part = F.when(F.col("rn") == 1, F.col(column)).otherwise(F.col(column) * (2.0 / (span + 1)))
        own[f"_{name}"] = F.sum(part * F.pow(F.lit(decay[name]), -F.col("_j"))).over(upto) * F.pow(F.lit(decay[name]), F.col("_j"))
    rows = rows.withColumns(own)
    ends = rows.groupBy("entity", "_b").agg(F.max_by(F.struct(*own), "_j").alias("own"))
    blocks = ends.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("_b", "own"))).alias("x"))
    state = ", ".join(f"{name}: double" for name in asked)
    zero = F.struct(*[F.lit(0.0).alias(name) for name in asked])

    def step(acc: Column, v: Column) -> Column:
        after = F.struct(*[(v["own"][f"_{n}"] + acc["e"][n] * decay[n] ** BLOCK).alias(n) for n in asked])
        return F.struct(after.alias("e"), F.concat(acc["out"], F.array(F.struct(v["_b"].alias("_b"), acc["e"].alias("before")))).alias("out"))

    start = F.struct(zero.alias("e"), F.array().cast(f"array<struct<_b: bigint, before: struct<{state}>>>").alias("out"))
    carried = blocks.select("entity", F.explode(F.aggregate("x", start, step)["out"]).alias("z")).select("entity", "z._b", "z.before")
    rows = rows.join(carried, ["entity", "_b"])
    return rows.withColumns({n: F.col(f"_{n}") + F.col(f"before.{n}") * F.pow(F.lit(decay[n]), F.col("_j") + 1) for n in asked}).drop("_b", "_j", "before", *own)


SPANS = (12, 26, 50, 200)


def ema(bars: DataFrame, spans: tuple[int, ...] = SPANS, digits: int = 6) -> DataFrame:
    """Recursive exponential averages and MACD of each entity's closes; bars without a close are left out."""
    rows = bars.filter("close is not null").select("entity", "date", "close", F.row_number().over(W.partitionBy("entity").orderBy("date")).alias("rn"))
    names = [f"ema_{s}" for s in spans]
    rows = recursive_averages(rows, {n: ("close", s) for n, s in zip(names, spans, strict=True)}).withColumn("dif", F.col(names[0]) - F.col(names[1]))
    rows = recursive_averages(rows, {"dea": ("dif", 9)}).withColumn("hist", 2 * (F.col("dif") - F.col("dea")))
    return rows.select("entity", "date", *[F.round(n, digits).alias(n) for n in (*names, "dif", "dea", "hist")])


def ema_sql(digits: int = 4) -> str:
    """The recursion itself, bar by bar."""
    one = lambda e, v, span: f"{e} + ({v} - {e}) * 2 / {span + 1}"
    e = {s: one(f"r.e{s}", "n.close", s) for s in SPANS}
    dif = f"(({e[12]}) - ({e[26]}))"
    first, after = ", ".join(f"close AS e{s}" for s in SPANS), ", ".join(f"{e[s]}" for s in SPANS)
    out = ", ".join(f"round(e{s}, {digits}) AS ema_{s}" for s in SPANS)
    return (
        f"WITH RECURSIVE {BARS_SQL}, n AS MATERIALIZED (SELECT entity, date, close, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn FROM bars), "
        f"r AS (SELECT entity, rn, date, {first}, CAST(0 AS DOUBLE) AS dea FROM n WHERE rn = 1 UNION ALL SELECT n.entity, n.rn, n.date, {after}, {one('r.dea', dif, 9)} FROM r JOIN n ON n.entity = r.entity AND n.rn = r.rn + 1) "
        f"SELECT entity, date, {out}, round(e12 - e26, {digits}) AS dif, round(dea, {digits}) AS dea, round(2 * (e12 - e26 - dea), {digits}) AS hist FROM r"
    )
