"""Factors from statements and valuations: joins by key and statement period, then plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_attributes(panel: DataFrame, attributes: DataFrame, date: str = "date", cap_unit: float = 1e4, turnover_unit: float = 100.0) -> DataFrame:
    """panel with each entity's static attributes: days_listed in calendar days, market_cap and turnover brought to their units; entities without attributes stay."""
    df = panel.join(attributes, "entity", "left").withColumn("days_listed", F.datediff(date, "list_date"))
    return df.withColumns({"market_cap": F.col("market_cap") / cap_unit, "turnover": F.col("turnover") / turnover_unit}).drop("list_date")


def join_financials(panel: DataFrame, statements: DataFrame, period: Column, overlay: tuple[str, ...] = ("pe", "pb", "ps", "pcf")) -> DataFrame:
    """panel with the statement of each row's period; where the panel has a valuation of its own, it goes before the statement's."""
    both = [c for c in overlay if c in panel.columns and c in statements.columns]
    right = statements.withColumnsRenamed({c: f"_s_{c}" for c in both})
    df = panel.withColumn("period", period).join(right, ["entity", "period"], "left")
    return df.withColumns({c: F.coalesce(c, f"_s_{c}") for c in both}).drop(*[f"_s_{c}" for c in both]) if both else df


def join_macro(panel: DataFrame, macro: DataFrame, keys: list[str], full: int = 68) -> DataFrame:
    """panel with macro_<key> of its month; in a month with under `full` keys, zeros and values that aren't finite count as missing.

    macro is long, (month_idx, key, value): a handful of rows a month, whatever the panel's size.
    """
    n = macro.groupBy("month_idx").agg(F.count("*").alias("_n"))
    usable = ~F.isnan("value") & (F.abs("value") != float("inf"))
    df = macro.join(n, "month_idx").withColumn("value", F.when(usable & ((F.col("value") != 0) | (F.col("_n") >= full)), F.col("value")))
    wide = df.groupBy("month_idx").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"macro_{k}") for k in keys])
    return panel.join(wide, "month_idx", "left")


def _within(c: str, low: float, high: float, closed: bool = False) -> Column:
    x = F.col(c)
    return F.when(x.between(low, high) if closed else (x > low) & (x < high), x)


def quality(df: DataFrame) -> DataFrame:
    """Adds the quality family; turnovers under 0 are missing."""
    plain = {"roe": "roe", "gross_margin": "grossprofit_margin", "debt_ratio": "debt_to_assets", "current_ratio": "current_ratio", "quick_ratio": "quick_ratio", "profit_growth": "netprofit_yoy", "roe_ex_nonrecurring": "roe_dt", "roe_weighted": "roe_waa", "ocf_to_revenue": "ocf_to_or", "ocf_to_profit": "ocf_to_profit", "debt_equity_ratio": "debt_eqt_ratio"}
    made = {f"quality_{k}": F.col(v) for k, v in plain.items()}
    made["quality_roa"] = F.col("roe") * (1 - F.col("debt_to_assets") / 100)
    made |= {f"quality_{k}_turnover": F.when(F.col(f"{k}_turn") >= 0, F.col(f"{k}_turn")) for k in ("inv", "ar")}
    return df.withColumns(made)


def value(df: DataFrame) -> DataFrame:
    """Adds the value family: ratios within their bounds, and their inverses."""
    bounds = {"pe": 500.0, "pb": 100.0, "ps": 100.0, "pcf": 500.0}
    df = df.withColumns({f"value_{k}_ratio": _within(k, 0.0, v) for k, v in bounds.items()})
    df = df.withColumns({f"value_{b}_ratio": 1 / F.col(f"value_{a}_ratio") for a, b in (("pe", "ep"), ("pb", "bp"), ("ps", "sp"), ("pcf", "cfp"))})
    return df.withColumn("value_ep_bp_avg", (F.col("value_ep_ratio") + F.col("value_bp_ratio")) / 2)


def growth(df: DataFrame, limit: float = 500.0) -> DataFrame:
    """Adds the growth family; rates beyond the limit are missing."""
    df = df.withColumns({f"growth_{k}": _within(v, -limit, limit, closed=True) for k, v in (("revenue_yoy", "or_yoy"), ("netprofit_yoy", "netprofit_yoy"), ("netprofit_q_yoy", "netprofit_q_yoy"), ("eps_yoy", "netprofit_q_yoy"))})
    return df.withColumn("growth_rev_profit_diff", F.col("growth_revenue_yoy") - F.col("growth_netprofit_yoy"))


def size(df: DataFrame) -> DataFrame:
    """Adds the size family of a positive market_cap."""
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    return df.withColumns({"size_log_mcap": F.log(cap), "size_log_mcap_neg": -F.log(cap), "size_sqrt_mcap": F.sqrt(cap), "size_log_mcap_cubed": F.pow(F.log(cap), F.lit(3))})


def dividend(df: DataFrame) -> DataFrame:
    """Adds the dividend family; payouts outside 0 to 200 percent are missing."""
    payout = _within("dv_ratio", 0.0, 200.0, closed=True)
    return df.withColumns({"dividend_payout_ratio": payout, "dividend_yield": payout / 100})


def styles(df: DataFrame) -> DataFrame:
    """Adds the members with values of the small style families; the others have no source and are always missing."""
    return df.withColumns({"aqr_quality": F.col("roe"), "aqr_profit_growth": F.col("netprofit_yoy"), "nm_gross_profitability": F.col("grossprofit_margin"), "barra_growth": F.col("netprofit_yoy"), "barra_quality": F.col("roe")})


#: Fixed names: the supplement family's valuation and statement columns, and where they come from.
PASSED = {
    "sup_val_pe_ttm": "pe", "sup_val_pb": "pb", "sup_val_ps_ttm": "ps", "sup_val_pcf_ttm": "pcf", "sup_val_div_yield": "div_yield",
    "sup_fin_roe_ttm": "roe", "sup_fin_roa_ttm": "roa", "sup_fin_gross_margin": "grossprofit_margin", "sup_fin_net_margin": "netprofit_margin", "sup_fin_asset_turnover": "asset_turnover",
    "sup_fin_current_ratio": "current_ratio", "sup_fin_quick_ratio": "quick_ratio", "sup_fin_debt_ratio": "debt_to_assets", "sup_fin_interest_coverage": "interest_coverage", "sup_fin_operating_cf": "operating_cashflow",
}


def passed(df: DataFrame) -> DataFrame:
    """Adds the valuations and statement columns that the supplement family passes on as they are; NULL where df lacks the column or it isn't a number."""
    return df.withColumns({k: F.col(v).try_cast("double") if v in df.columns else F.lit(None).cast("double") for k, v in PASSED.items()})
