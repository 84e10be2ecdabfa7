"""Queries on cross-sections: standardising, ranks, neutralising, information coefficients, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank_sql, inv_norm_sql, rank_pct_sql
from tessera.operators import cross, factors
from tessera.sources.tables import BARS_SQL, PANEL_SQL, bars, panel, table, with_target
from tessera.streaming.feeds import written

FACTORS = ["f_qty", "f_disc", "f_tax", "f_count"]
CELL = "PARTITION BY month_idx, factor"


def cells(spark, sf_dir, target: bool = False) -> DataFrame:
    """The panel in long form; values of every seventh part are missing, every eleventh has no industry."""
    df = panel(spark, sf_dir)
    df = with_target(df) if target else df.withColumn("target", F.lit(None).cast("double"))
    df = written(df.select("entity", "month_idx", "industry", "market_cap", "target", *FACTORS))  # read several times
    df = cross.long_form(df, FACTORS, ["entity", "month_idx", "industry", "market_cap", "target"])
    return df.withColumn("y", F.when(F.col("entity") % 7 != 3, F.col("y"))).withColumn("industry", F.when(F.col("entity") % 11 != 5, F.col("industry")))


CELLS_SQL = f"""WITH {PANEL_SQL},
c0 AS (UNPIVOT (SELECT entity, month_idx, industry, market_cap, target, f_qty, f_disc, f_tax, f_count FROM panel) ON f_qty, f_disc, f_tax, f_count INTO NAME factor VALUE y),
c AS (SELECT entity, month_idx, factor, market_cap, target, CASE WHEN entity % 7 <> 3 THEN y END AS y, CASE WHEN entity % 11 <> 5 THEN industry END AS industry FROM c0)"""

Z = lambda e, src: f"SELECT entity, month_idx, factor, round(CASE WHEN {e} IS NULL OR count({e}) OVER w < 2 THEN NULL WHEN stddev_pop({e}) OVER w < 1e-8 THEN 0.0 ELSE ({e} - avg({e}) OVER w) / stddev_pop({e}) OVER w END, 5) AS z FROM {src} WINDOW w AS ({CELL})"
WINSOR = f"""w1 AS (SELECT *, median(y) OVER ({CELL}) AS med, count(y) OVER ({CELL}) AS ny FROM c),
w2 AS (SELECT *, median(abs(y - med)) OVER ({CELL}) AS mad FROM w1),
w3 AS (SELECT * EXCLUDE (y, med, mad, ny), CASE WHEN y IS NULL OR mad < 1e-8 OR ny < 2 THEN y ELSE greatest(least(y, med + 3 * 1.4826 * mad), med - 3 * 1.4826 * mad) END AS y FROM w2)"""


def normal_sql(src: str) -> str:
    return f"""n1 AS (SELECT *, {avg_rank_sql("y", "month_idx", "factor")} AS rk, count(y) OVER ({CELL}) AS ny FROM {src}),
n2 AS (SELECT * EXCLUDE (y, rk, ny), CASE WHEN y IS NULL THEN NULL WHEN ny < 10 THEN y ELSE {inv_norm_sql("rk / (ny + 1)")} END AS y FROM n1)"""


def residual_sql(src: str, weight: str = "1.0", restore: bool = False) -> str:
    return f"""r0 AS (SELECT *, y IS NULL AS miss FROM {src}),
r1 AS (SELECT entity, month_idx, factor, miss, coalesce(y, 0) AS y, ln(greatest(market_cap, 1.0)) AS x, coalesce(industry, min(industry) OVER ({CELL})) AS ind, {weight} AS w FROM r0),
r2 AS (SELECT *, y - sum(w * y) OVER i / sum(w) OVER i AS dy, x - sum(w * x) OVER i / sum(w) OVER i AS dx FROM r1 WINDOW i AS (PARTITION BY month_idx, factor, ind)),
r3 AS (SELECT *, sum(w * dx * dx) OVER ({CELL}) AS sxx, sum(w * dx * dy) OVER ({CELL}) AS sxy FROM r2),
r4 AS (SELECT entity, month_idx, factor, CASE WHEN {"miss" if restore else "false"} THEN NULL ELSE dy - CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0.0 END * dx END AS e FROM r3)"""


def scores(f):
    return lambda spark, sf_dir: f(cells(spark, sf_dir)).select("entity", "month_idx", "factor", F.round("z", 5).alias("z"))


def values(f, digits=6):
    return lambda spark, sf_dir: f(cells(spark, sf_dir)).select("entity", "month_idx", "factor", F.round("y", digits).alias("y"))


#: Factors of the brands that the style and component schemes neutralise beside the styles themselves.
TARGETS = ["momentum_return_120d", "momentum_return_5d", "volatility_hist_10d", "liquidity_avg_turnover_5d", "momentum_rsi_14d", "momentum_price_position_20d"]
STYLES = ["momentum_return_20d", "momentum_return_60d", "volatility_hist_20d", "volatility_hist_60d", "liquidity_avg_turnover_20d", "jq_turnover_60d"]


def brands(spark, sf_dir) -> DataFrame:
    """Month-end factors of every brand with its size (closing price times the sizes of its parts) and one of four groups of brands as industry."""
    about = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.min(F.split("p_brand", "#")[1].cast("int") % 4).cast("string").alias("industry"), F.sum("p_size").alias("_sizes"))
    df = factors.family(bars(spark, sf_dir), "style").join(about, "entity")
    return df.withColumn("month_idx", F.year("date") * 12 + F.month("date")).withColumn("market_cap", F.col("close") * F.col("_sizes")).drop("date", "close", "_sizes")


def _scheme_f(spark, sf_dir):
    df = written(brands(spark, sf_dir))
    return cross.neutralize_f(cross.long_form(df, TARGETS, ["entity", "month_idx"]), df).select("entity", "month_idx", "factor", F.round("z", 5).alias("z"))


def _scheme_g(alignment):
    def run(spark, sf_dir):
        df = cross.long_form(written(brands(spark, sf_dir)), [*TARGETS, *STYLES], ["entity", "month_idx"])
        return cross.neutralize_g(df, cross.returns_at_month_ends(bars(spark, sf_dir)), alignment=alignment).select("entity", "month_idx", "factor", F.round("z", 5).alias("z"))

    return run


def _month_returns(spark, sf_dir):
    df = cross.returns_at_month_ends(bars(spark, sf_dir)).select("entity", "month_idx", F.posexplode("returns").alias("age", "r"))
    return df.withColumn("r", F.round("r", 8))


def eliminated_sql(src: str, xs: list[str], cell: str, start: str) -> tuple[str, str]:
    """CTEs that take columns xs out of y, one after the other, each less what it shares with those before; and the last one's name. Columns keep, y and xs of src are already demeaned."""
    out, at = [], src
    for k, x in enumerate(xs):
        rest = ["y", *xs[k + 1 :]]
        square = f"sum({x} * {x}) OVER ({cell})"
        cells = ", ".join(f"{c} - CASE WHEN {square} > 1e-12 THEN sum({x} * {c}) OVER ({cell}) / {square} ELSE 0.0 END * {x} AS {c}" for c in rest)
        out.append(f"{start}{k} AS (SELECT entity, month_idx, factor, miss, {cells} FROM {at})")
        at = f"{start}{k}"
    return ", ".join(out), at


def _ic(spark, sf_dir):
    return cross.grouped_ic(cells(spark, sf_dir, True))


def _misvaluation_input(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "month_idx", (F.col("close") / 100).alias("pb"), (F.col("f_qty") / 100).alias("x"))


QUERIES = {
    "zscore": scores(cross.zscore),
    "zscore_fill": scores(cross.zscore_fill),
    "mad_winsorize": values(cross.winsorize),
    "rank_normal_v1": values(lambda df: cross.rank_normal(df, 1), 9),
    "rank_normal_v2": values(lambda df: cross.rank_normal(df, 2), 9),
    "rank_pct_industry": lambda s, d: cross.rank_pct(cells(s, d)).select("entity", "month_idx", "factor", F.round("y", 9).alias("pct")),
    "neutralize_a": scores(lambda df: cross.neutralize(df, "a")),
    "neutralize_b": scores(lambda df: cross.neutralize(df, "b")),
    "neutralize_d": scores(lambda df: cross.neutralize(df, "d")),
    "neutralize_e": scores(lambda df: cross.neutralize(df, "e")),
    "neutralize_b2": scores(lambda df: cross.neutralize(df, "b2")),
    "neutralize_b1": scores(lambda df: cross.neutralize(df, "b1")),
    "neutralize_f": _scheme_f,
    "neutralize_g": _scheme_g("drop"),
    "neutralize_g_imputed": _scheme_g("impute"),
    "month_end_returns": _month_returns,
    "grouped_ic": lambda s, d: _ic(s, d).select("month_idx", "factor", "n", F.round("ic", 8).alias("ic")),
    "icir": lambda s, d: cross.icir(_ic(s, d)).select("factor", *[F.round(c, 8).alias(c) for c in ("mean_ic", "std_ic", "icir")]),
    "quantile_spread": lambda s, d: cross.quantile_spread(cells(s, d, True)).withColumn("spread", F.round("spread", 8)),
    "median_split_spread": lambda s, d: cross.median_spread(cells(s, d, True)).withColumn("spread", F.round("spread", 8)),
    "misvaluation": lambda s, d: cross.misvaluation(_misvaluation_input(s, d)).select("entity", "month_idx", F.round("misvaluation", 6).alias("misvaluation")),
}

_PAIRS = f"{CELLS_SQL}, p AS (SELECT * FROM c WHERE y IS NOT NULL AND target IS NOT NULL), k AS (SELECT *, {avg_rank_sql('y', 'month_idx', 'factor')} AS ry, {avg_rank_sql('target', 'month_idx', 'factor')} AS rt FROM p), ic AS (SELECT month_idx, factor, count(*) AS n, CASE WHEN stddev_pop(ry) > 0 AND stddev_pop(rt) > 0 THEN corr(ry, rt) END AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 10)"
_NORMAL = lambda src: f"""n1 AS (SELECT *, {avg_rank_sql("y", "month_idx", "factor")} AS rk, count(y) OVER ({CELL}) AS ny FROM {src}), n2 AS (SELECT *, greatest(least((rk - 0.5) / ny, 1 - 1e-6), 1e-6) AS p FROM n1),
n3 AS (SELECT * EXCLUDE (y, rk, ny, p), CASE WHEN y IS NOT NULL AND ny >= 2 THEN {inv_norm_sql('p')} END AS y FROM n2)"""  # noqa: E731
_DEMEAN = lambda cols: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY month_idx, factor, ind) AS {c}" for c in cols)


def _b1_sql() -> str:
    xs = ["s1", "s2", "s3"]
    chain, last = eliminated_sql("d0", xs, CELL, "g")
    return f"""{CELLS_SQL}, {_NORMAL('c')}, x0 AS (SELECT *, y IS NULL AS miss, coalesce(industry, min(industry) OVER ({CELL})) AS ind, ln(greatest(market_cap, 1.0)) - avg(ln(greatest(market_cap, 1.0))) OVER ({CELL}) AS s1 FROM c),
x1 AS (SELECT n3.entity, n3.month_idx, n3.factor, miss, ind, coalesce(n3.y, 0) AS y, s1, s1 * s1 AS s2, s1 * s1 * s1 AS s3 FROM n3 JOIN x0 USING (entity, month_idx, factor)),
d0 AS (SELECT entity, month_idx, factor, miss, {_DEMEAN(["y", *xs])} FROM x1), {chain}, r4 AS (SELECT entity, month_idx, factor, CASE WHEN NOT miss THEN y END AS e FROM {last}) {Z('e', 'r4')}"""


def _f_sql() -> str:
    xs = ["size", *[f"n_{s}" for s in STYLES]]
    chain, last = eliminated_sql("d0", xs, CELL, "g")
    everything = ", ".join([*TARGETS, *STYLES])
    pivot = ", ".join(f"coalesce(max(CASE WHEN factor = '{s}' THEN y END), 0) AS n_{s}" for s in STYLES)
    return f"""WITH fam AS ({factors.family_sql("style")}), ab AS (SELECT p_brand AS entity, min(CAST(string_split(p_brand, '#')[2] AS INTEGER) % 4)::VARCHAR AS ind, sum(p_size) AS sizes FROM part GROUP BY 1),
wide AS (SELECT fam.*, year(date) * 12 + month(date) AS month_idx, ind, ln(greatest(close * sizes, 1.0)) AS size FROM fam JOIN ab USING (entity)),
c AS (SELECT * FROM (SELECT entity, month_idx, {everything} FROM wide) UNPIVOT INCLUDE NULLS (y FOR factor IN ({everything}))), {_NORMAL('c')},
nx AS (SELECT entity, month_idx, {pivot} FROM n3 GROUP BY 1, 2),
x1 AS (SELECT n3.entity, n3.month_idx, factor, y IS NULL AS miss, coalesce(y, 0) AS y, ind, size, {", ".join(xs[1:])} FROM n3 JOIN nx USING (entity, month_idx) JOIN wide USING (entity, month_idx)),
d0 AS (SELECT entity, month_idx, factor, miss, {_DEMEAN(["y", *xs])} FROM x1), {chain}, r4 AS (SELECT entity, month_idx, factor, CASE WHEN NOT miss THEN y END AS e FROM {last}) {Z('e', 'r4')}"""


_ROOT = "CASE WHEN market_cap > 0 THEN sqrt(market_cap) ELSE 0.0 END"
SQL = {
    "zscore": f"{CELLS_SQL} {Z('y', 'c')}",
    "zscore_fill": f"{CELLS_SQL} SELECT entity, month_idx, factor, round((coalesce(y, 0) - avg(coalesce(y, 0)) OVER w) / (stddev_pop(coalesce(y, 0)) OVER w + 1e-6), 5) AS z FROM c WINDOW w AS ({CELL})",
    "mad_winsorize": f"{CELLS_SQL}, {WINSOR} SELECT entity, month_idx, factor, round(y, 6) AS y FROM w3",
    "rank_normal_v1": f"{CELLS_SQL}, {normal_sql('c')} SELECT entity, month_idx, factor, round(y, 9) AS y FROM n2",
    "rank_normal_v2": f"{CELLS_SQL}, q AS (SELECT *, {avg_rank_sql('y', 'month_idx', 'factor')} AS rk, count(y) OVER ({CELL}) AS ny FROM c), q2 AS (SELECT *, greatest(least((rk - 0.5) / ny, 1 - 1e-6), 1e-6) AS p FROM q) SELECT entity, month_idx, factor, round(CASE WHEN y IS NOT NULL AND ny >= 2 THEN {inv_norm_sql('p')} END, 9) AS y FROM q2",
    "rank_pct_industry": f"{CELLS_SQL} SELECT entity, month_idx, factor, round({rank_pct_sql('y', 'month_idx', 'factor', 'industry')}, 9) AS pct FROM c",
    "neutralize_a": f"{CELLS_SQL}, {residual_sql('c')} {Z('e', 'r4')}",
    "neutralize_b": f"{CELLS_SQL}, {WINSOR}, {normal_sql('w3')}, {residual_sql('n2')} {Z('e', 'r4')}",
    "neutralize_d": f"{CELLS_SQL}, r1 AS (SELECT entity, month_idx, factor, coalesce(y, 0) AS y, coalesce(industry, min(industry) OVER ({CELL})) AS ind FROM c), r4 AS (SELECT *, y - avg(y) OVER (PARTITION BY month_idx, factor, ind) AS e FROM r1) {Z('e', 'r4')}",
    "neutralize_e": f"{CELLS_SQL}, {WINSOR}, r1 AS (SELECT entity, month_idx, factor, coalesce({rank_pct_sql('y', 'month_idx', 'factor', 'industry')}, 0) AS y, ln(greatest(market_cap, 1.0)) AS x FROM w3), r4 AS (SELECT *, y - regr_intercept(y, x) OVER ({CELL}) - regr_slope(y, x) OVER ({CELL}) * x AS e FROM r1) {Z('e', 'r4')}",
    "neutralize_b2": f"{CELLS_SQL}, {residual_sql('c', f'{_ROOT} / avg({_ROOT}) OVER ({CELL})', True)} {Z('e', 'r4')}",
    "neutralize_b1": _b1_sql(),
    "neutralize_f": _f_sql(),
    "month_end_returns": f"""WITH {BARS_SQL}, b0 AS (SELECT entity, date, row_number() OVER w AS rn, ln(close / lag(close) OVER w) AS r, coalesce(date_trunc('month', lead(date) OVER w) <> date_trunc('month', date), true) AS me FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
e AS (SELECT entity, rn, year(date) * 12 + month(date) AS month_idx FROM b0 WHERE me AND rn > 60) SELECT e.entity, month_idx, CAST(e.rn - b0.rn AS INTEGER) AS age, round(r, 8) AS r FROM e JOIN b0 ON e.entity = b0.entity AND b0.rn BETWEEN e.rn - 59 AND e.rn""",
    "grouped_ic": f"{_PAIRS} SELECT month_idx, factor, n, round(ic, 8) AS ic FROM ic",
    "icir": f"{_PAIRS} SELECT factor, round(avg(ic), 8) AS mean_ic, round(stddev_pop(ic), 8) AS std_ic, round(CASE WHEN stddev_pop(ic) < 1e-4 THEN 0.0 ELSE greatest(least(avg(ic) / stddev_pop(ic), 5.0), -5.0) END, 8) AS icir FROM ic GROUP BY 1",
    "quantile_spread": f"{CELLS_SQL}, p AS (SELECT * FROM c WHERE y IS NOT NULL AND target IS NOT NULL), g AS (SELECT month_idx, factor, list_sort(list_distinct(quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM p GROUP BY 1, 2 HAVING count(*) >= 50) SELECT month_idx, factor, round(avg(CASE WHEN y > ed[-2] THEN target END) - avg(CASE WHEN y <= ed[2] THEN target END), 8) AS spread FROM p JOIN g USING (month_idx, factor) WHERE len(ed) > 2 GROUP BY 1, 2",
    "median_split_spread": f"{CELLS_SQL}, p AS (SELECT *, median(y) OVER ({CELL}) AS m FROM c WHERE y IS NOT NULL AND target IS NOT NULL) SELECT month_idx, factor, round(avg(CASE WHEN y <= m THEN target END) - avg(CASE WHEN y > m THEN target END), 8) AS spread FROM p GROUP BY 1, 2",
    "misvaluation": f"WITH {PANEL_SQL}, p AS (SELECT entity, month_idx, close / 100 AS pb, f_qty / 100 AS x FROM panel0), g AS (SELECT month_idx, count(*) AS n, regr_sxx(pb, x) AS sxx, regr_slope(pb, x) AS g1, regr_intercept(pb, x) AS g0 FROM p WHERE pb > 0 AND abs(x) < 10 GROUP BY 1) SELECT entity, month_idx, round(CASE WHEN pb > 0 AND abs(x) < 10 AND n >= 30 AND sxx >= 1e-10 THEN greatest(least((g0 + g1 * x) / pb - 1, 5.0), -5.0) END, 6) AS misvaluation FROM p LEFT JOIN g USING (month_idx)",
}
