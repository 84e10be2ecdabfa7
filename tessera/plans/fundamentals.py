"""Queries of statement, valuation and macro factors. Statements are quarters of parts, from the items shipped in them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import fundamentals as ops
from tessera.sources import ingest
from tessera.sources.tables import PANEL_SQL, panel, table

from .strategy import rounded

MACRO = ["orders", "total", "urgent", "flat"]
_YOY = {"or_yoy": ("revenue", 4), "netprofit_yoy": ("profit", 4), "netprofit_q_yoy": ("profit", 1)}


def statements(s, d) -> DataFrame:
    q = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("q")
    # dealt by entity once: quarters and the quarters before them need no other shuffle
    items = table(s, d, "lineitem").filter("l_partkey is not null").withColumn("entity", F.col("l_partkey")).select("entity", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    g = items.repartition("entity").groupBy("entity", q).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("profit"),
        F.round(F.avg("l_discount"), 8).alias("disc"), F.round(F.avg("l_tax"), 8).alias("tax"), F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("n"),
    )
    for name, (c, back) in _YOY.items():
        old = F.first(c).over(W.partitionBy("entity").orderBy("q").rangeBetween(-back, -back))  # the one row of that quarter, if any
        g = g.withColumn("_old", old).withColumn(name, F.when(F.col("_old") > 0, (F.col(c) / F.col("_old") - 1) * 100)).drop("_old")
    year, quarter = F.floor((F.col("q") - 1) / 4).cast("int"), (F.col("q") - 1) % 4
    ends = F.element_at(F.array(*map(F.lit, ("0331", "0630", "0930", "1231"))), (quarter + 1).cast("int"))
    return g.select(
        "entity", F.concat(F.format_string("%04d", year), ends).alias("period"), *_YOY, (F.col("disc") * 300).alias("roe"), (F.col("disc") * 280).alias("roe_dt"), (F.col("disc") * 290).alias("roe_waa"),
        (100 - F.col("disc") * 100).alias("grossprofit_margin"), (F.col("tax") * 900).alias("debt_to_assets"), (F.col("qty") / 50).alias("current_ratio"), (F.col("qty") / 80).alias("quick_ratio"),
        (F.col("qty") / F.col("n") - 20).alias("inv_turn"), (F.col("n") - 2).alias("ar_turn"), (F.col("tax") * 100).alias("ocf_to_or"), (F.col("tax") * 50 - 1).alias("ocf_to_profit"), (F.col("tax") * 9).alias("debt_eqt_ratio"),
        (F.col("disc") * F.col("n") * 900).alias("dv_ratio"), (F.col("n") * 30).alias("pe"),
        F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100).alias("netprofit_margin"), (F.col("disc") * (300 - F.col("tax") * 2700) / 1.37).alias("roa"), (F.col("revenue") / F.col("qty") / 1037).alias("asset_turnover"),
        F.when(F.col("tax") > 0, F.col("disc") / F.col("tax")).alias("interest_coverage"), (F.col("revenue") * F.col("tax") / 1.37).alias("operating_cashflow"), (F.col("disc") * 40).alias("div_yield"),
    )


STATEMENTS_SQL = """g0 AS (SELECT l_partkey AS entity, year(l_shipdate) * 4 + quarter(l_shipdate) AS q, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * l_discount), 4) AS profit,
  round(avg(l_discount), 8) AS disc, round(avg(l_tax), 8) AS tax, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1, 2),
st AS (SELECT g0.entity, ((g0.q - 1) // 4)::VARCHAR || ['0331', '0630', '0930', '1231'][(g0.q - 1) % 4 + 1] AS period,
  CASE WHEN y.revenue > 0 THEN (g0.revenue / y.revenue - 1) * 100 END AS or_yoy, CASE WHEN y.profit > 0 THEN (g0.profit / y.profit - 1) * 100 END AS netprofit_yoy, CASE WHEN p.profit > 0 THEN (g0.profit / p.profit - 1) * 100 END AS netprofit_q_yoy,
  g0.disc * 300 AS roe, g0.disc * 280 AS roe_dt, g0.disc * 290 AS roe_waa, 100 - g0.disc * 100 AS grossprofit_margin, g0.tax * 900 AS debt_to_assets, g0.qty / 50 AS current_ratio, g0.qty / 80 AS quick_ratio,
  g0.qty / g0.n - 20 AS inv_turn, g0.n - 2 AS ar_turn, g0.tax * 100 AS ocf_to_or, g0.tax * 50 - 1 AS ocf_to_profit, g0.tax * 9 AS debt_eqt_ratio, g0.disc * g0.n * 900 AS dv_ratio, g0.n * 30.0 AS s_pe,
  CASE WHEN g0.revenue > 0 THEN g0.profit / g0.revenue * 100 END AS netprofit_margin, g0.disc * (300 - g0.tax * 2700) / 1.37 AS roa, g0.revenue / g0.qty / 1037 AS asset_turnover, CASE WHEN g0.tax > 0 THEN g0.disc / g0.tax END AS interest_coverage, g0.revenue * g0.tax / 1.37 AS operating_cashflow, g0.disc * 40 AS div_yield
  FROM g0 LEFT JOIN g0 y ON y.entity = g0.entity AND y.q = g0.q - 4 LEFT JOIN g0 p ON p.entity = g0.entity AND p.q = g0.q - 1)"""


def _dated(s, d) -> DataFrame:
    """The panel with a date and valuations of the month; a price-earnings ratio only where several items were shipped."""
    m = F.col("month_idx") - 1
    df = panel(s, d).withColumn("date", F.last_day(F.make_date((m / 12).cast("int"), m % 12 + 1, F.lit(1))))
    return df.withColumns({"pe": F.when(F.col("f_count") > 1, F.col("close") / 3.17), "pb": F.col("close") / 15.37 - 5, "ps": F.col("f_qty") - 2, "pcf": F.col("f_count") * 170 - 180})


def financials(s, d) -> DataFrame:
    return ops.join_financials(_dated(s, d), statements(s, d), ingest.report_period(F.col("date")))


FINANCIALS_SQL = f"""WITH {PANEL_SQL}, {STATEMENTS_SQL},
dt AS (SELECT *, (month_idx - 1) // 12 AS y, (month_idx - 1) % 12 + 1 AS mo, CASE WHEN f_count > 1 THEN close / 3.17 END AS v_pe, close / 15.37 - 5 AS pb, f_qty - 2 AS ps, f_count * 170 - 180 AS pcf FROM panel0),
fi AS (SELECT dt.*, st.* EXCLUDE (entity, period), coalesce(v_pe, s_pe) AS pe FROM dt LEFT JOIN st ON st.entity = dt.entity
  AND st.period = CASE WHEN mo <= 3 THEN (y - 1)::VARCHAR || '1231' WHEN mo <= 6 THEN y::VARCHAR || '0331' WHEN mo <= 9 THEN y::VARCHAR || '0630' ELSE y::VARCHAR || '0930' END)"""


def _listed(s, d) -> DataFrame:
    """Parts with the day they were first shipped."""
    first = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.min(F.to_date("l_shipdate")).alias("list_date"))
    return table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name")).join(first, "entity", "left")


def _attributed(s, d) -> DataFrame:
    df = _dated(s, d).select("entity", "month_idx", "date", "market_cap", F.col("f_qty").alias("turnover"))
    return ops.join_attributes(df, _listed(s, d)).select("entity", "month_idx", "name", "days_listed", F.round("market_cap", 8).alias("market_cap"), F.round("turnover", 8).alias("turnover"))


def _macro(s, d) -> DataFrame:
    g = table(s, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_idx")).agg(F.count("*").cast("double").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"), F.lit(0.0).alias("flat"))
    long = g.select("month_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in MACRO])).alias("z")).select("month_idx", "z.*")
    return rounded(ops.join_macro(panel(s, d).select("entity", "month_idx"), long, MACRO), 4)


_FAMILIES = {"quality": ops.quality, "value": ops.value, "growth": ops.growth, "size": ops.size, "dividend": ops.dividend, "styles": ops.styles, "passed": ops.passed}
_DIGITS = {"value": 4, "passed": 4}  # the panel's closes are rounded averages, which may end in a tie


def _family(name, s, d) -> DataFrame:
    before = financials(s, d)
    df = _FAMILIES[name](before)
    return df.select("entity", "month_idx", *[F.round(c, _DIGITS.get(name, 7)).alias(c) for c in df.columns if c not in before.columns])


def _sql(digits: int = 7, **columns: str) -> str:
    return f"{FINANCIALS_SQL} SELECT entity, month_idx, " + ", ".join(f"round({v}, {digits}) AS {k}" for k, v in columns.items()) + " FROM fi"


def _bound(c: str, high: int) -> str:
    return f"CASE WHEN {c} > 0 AND {c} < {high} THEN {c} END"


_PE, _PB, _PS, _PCF = _bound("pe", 500), _bound("pb", 100), _bound("ps", 100), _bound("pcf", 500)
QUERIES = {f"factor_{name}": partial(_family, name) for name in _FAMILIES}
QUERIES |= {"join_attributes": _attributed, "join_macro": _macro, "join_financials": lambda s, d: rounded(financials(s, d).select("entity", "month_idx", "period", "roe", "pe", "pb", "netprofit_yoy"), 4)}
SQL = {
    "factor_quality": _sql(quality_roe="roe", quality_gross_margin="grossprofit_margin", quality_debt_ratio="debt_to_assets", quality_current_ratio="current_ratio", quality_quick_ratio="quick_ratio", quality_profit_growth="netprofit_yoy", quality_roe_ex_nonrecurring="roe_dt", quality_roe_weighted="roe_waa", quality_ocf_to_revenue="ocf_to_or", quality_ocf_to_profit="ocf_to_profit", quality_debt_equity_ratio="debt_eqt_ratio", quality_roa="roe * (1 - debt_to_assets / 100)", quality_inv_turnover="CASE WHEN inv_turn >= 0 THEN inv_turn END", quality_ar_turnover="CASE WHEN ar_turn >= 0 THEN ar_turn END"),
    "factor_value": _sql(4, value_pe_ratio=_PE, value_pb_ratio=_PB, value_ps_ratio=_PS, value_pcf_ratio=_PCF, value_ep_ratio=f"1 / ({_PE})", value_bp_ratio=f"1 / ({_PB})", value_sp_ratio=f"1 / ({_PS})", value_cfp_ratio=f"1 / ({_PCF})", value_ep_bp_avg=f"(1 / ({_PE}) + 1 / ({_PB})) / 2"),
    "factor_growth": _sql(growth_revenue_yoy="CASE WHEN abs(or_yoy) <= 500 THEN or_yoy END", growth_netprofit_yoy="CASE WHEN abs(netprofit_yoy) <= 500 THEN netprofit_yoy END", growth_netprofit_q_yoy="CASE WHEN abs(netprofit_q_yoy) <= 500 THEN netprofit_q_yoy END", growth_eps_yoy="CASE WHEN abs(netprofit_q_yoy) <= 500 THEN netprofit_q_yoy END", growth_rev_profit_diff="CASE WHEN abs(or_yoy) <= 500 AND abs(netprofit_yoy) <= 500 THEN or_yoy - netprofit_yoy END"),
    "factor_size": _sql(size_log_mcap="ln(market_cap)", size_log_mcap_neg="-ln(market_cap)", size_sqrt_mcap="sqrt(market_cap)", size_log_mcap_cubed="pow(ln(market_cap), 3)"),
    "factor_dividend": _sql(dividend_payout_ratio="CASE WHEN dv_ratio BETWEEN 0 AND 200 THEN dv_ratio END", dividend_yield="CASE WHEN dv_ratio BETWEEN 0 AND 200 THEN dv_ratio / 100 END"),
    "factor_passed": _sql(4, **ops.PASSED),
    "factor_styles": _sql(aqr_quality="roe", aqr_profit_growth="netprofit_yoy", nm_gross_profitability="grossprofit_margin", barra_growth="netprofit_yoy", barra_quality="roe"),
    "join_financials": f"{FINANCIALS_SQL} SELECT entity, month_idx, CASE WHEN mo <= 3 THEN (y - 1)::VARCHAR || '1231' WHEN mo <= 6 THEN y::VARCHAR || '0331' WHEN mo <= 9 THEN y::VARCHAR || '0630' ELSE y::VARCHAR || '0930' END AS period, round(roe, 4) AS roe, round(pe, 4) AS pe, round(pb, 4) AS pb, round(netprofit_yoy, 4) AS netprofit_yoy FROM fi",
    "join_attributes": f"WITH {PANEL_SQL}, f AS (SELECT l_partkey AS entity, CAST(min(l_shipdate) AS DATE) AS first FROM lineitem GROUP BY 1) SELECT a.entity, a.month_idx, p_name AS name, date_diff('day', first, last_day(make_date(CAST((a.month_idx - 1) // 12 AS INTEGER), CAST((a.month_idx - 1) % 12 + 1 AS INTEGER), 1))) AS days_listed, round(market_cap / 10000, 8) AS market_cap, round(f_qty / 100, 8) AS turnover FROM panel0 a LEFT JOIN part ON p_partkey = a.entity LEFT JOIN f ON f.entity = a.entity",
    "join_macro": f"WITH {PANEL_SQL}, m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month_idx, count(*)::DOUBLE AS orders, round(avg(o_totalprice), 4) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) SELECT entity, a.month_idx, orders AS macro_orders, total AS macro_total, nullif(urgent, 0)::DOUBLE AS macro_urgent, CAST(NULL AS DOUBLE) AS macro_flat FROM panel0 a LEFT JOIN m USING (month_idx)",
}
