"""Queries of decisions and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import attribution, overlay, selection
from tessera.sources.tables import PANEL_SQL, panel, table, with_target
from tessera.streaming.feeds import written

from .align import SQL as ALIGN
from .align import _gap
from .reports import TR, _trials
from .strategy import FEATURES, M, O, _overlay_input, base, held, monthly, rounded

GROUPS = {"a_": "first", "b_": "second"}


def _tuned(s, d) -> DataFrame:
    """One trial a part, with the parameters of two members."""
    key = F.col("p_partkey")
    params = F.create_map(F.lit("a_learning_rate"), (key % 10 / 100).cast("string"), F.lit("a_n_estimators"), (key % 900).cast("string"), F.lit("b_max_depth"), F.col("p_size").cast("string"), F.lit("scheme"), F.lit("x"), F.lit("top"), F.col("p_size").cast("string"))
    return table(s, d, "part").select(key.alias("number"), params.alias("params"))


def _gated(s, d) -> DataFrame:
    a = lambda m: F.nanvl(F.col("attrs")[m], F.lit(None).cast("double"))
    return selection.quality_gate(_trials(s, d).filter("state = 'COMPLETE' and not isnan(value)"), {"ic": a("val_ic") > 0.02, "sharpe": a("sharpe_ratio") < 1.2}, least=-1500.0)


def _rates(s, d) -> DataFrame:
    g = table(s, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_idx"))
    g = g.agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return g.select("month_idx", F.when(F.col("u") % 2 == 0, F.col("u") / 10).alias("short"), F.when(F.col("p") % 3 != 0, F.col("p") / 10).alias("long"))


def _view(s, d) -> DataFrame:
    universe = base(s, d)
    df = selection.holdings_view(held(s, d, universe), overlay.run(_overlay_input(s, d, universe)))
    return df.select("series", "month_idx", "entity", "weight", F.round("contribution", 10).alias("contribution"), "action")


def _done(s, d, universe: DataFrame | None = None) -> DataFrame:
    """What the overlay did, written once for those who read it twice."""
    return written(overlay.run(_overlay_input(s, d, universe)).select("seq", "entity", "weight", "sold", "label"))


def _overlaid(s, d) -> DataFrame:
    universe = base(s, d)
    done = _done(s, d, universe)
    df = attribution.brinson(attribution.overlaid(selection.with_cash(done), universe), universe)
    return df.select("series", "month_idx", "industry", "w_port", "r_port", "allocation", "selection", "interaction")


QUERIES = {
    "brinson_overlay": lambda s, d: rounded(_overlaid(s, d), 13),
    "screen_decisions": lambda s, d: selection.decide(with_target(panel(s, d)), FEATURES, max_corr=0.8),
    "screen_apply": lambda s, d: selection.Screen.fit(with_target(panel(s, d)), FEATURES, max_corr=0.8).apply(panel(s, d), ["entity", "month_idx"]),
    "last_n_windows": lambda s, d: selection.last_n_windows(panel(s, d).select("entity", "month_idx", "f_qty"), 12),
    "window_summary": lambda s, d: rounded(selection.window_summary(_gap(s, d)), 7),
    "mode_schema": lambda s, d: selection.mode_schema(with_target(panel(s, d)), ["target", *FEATURES]),
    "monthly_rf": lambda s, d: rounded(selection.monthly_rf(_rates(s, d), ["short", "long"]), 9),
    "month_keys": lambda s, d: selection.month_keys(panel(s, d).select("entity", "pred_month", F.when(F.col("f_count") > 1, F.col("industry")).alias("name"))),
    "overlay_with_cash": lambda s, d: rounded(selection.with_cash(_done(s, d)), 8),
    "holdings_view": _view,
    "validation_extras": lambda s, d: rounded(selection.validation_extras(monthly(s, d)), 6),
    "trial_cap_params": lambda s, d: selection.cap_params(_tuned(s, d), GROUPS),
    "trial_quality_gate": lambda s, d: _gated(s, d).select("number", "value"),
    "trial_verdict": lambda s, d: rounded(selection.verdict(_gated(s, d), _trials(s, d)), 9),
    "trial_reuse": lambda s, d: rounded(selection.reuse(_trials(s, d).filter("state = 'COMPLETE'").withColumn("scheme", F.col("params")["kind"].substr(1, 5)), "PROMO", {"size": (5, 40)}, {"val_ic": 2.0, "val_icir": -1.0}).select("number", "score"), 9),
}
_FEATS = ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATURES))
_STATS = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NOT NULL AS DOUBLE)) AS coverage, coalesce(stddev_samp({c}), 0) AS std, abs(corr(coalesce({c}, 0), target)) AS ic FROM pt" for c in FEATURES)
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM pt" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])
_DECIDE = f"""WITH {PANEL_SQL}, pt AS (SELECT * FROM panel WHERE target IS NOT NULL), fs(feature, place) AS (VALUES {_FEATS}), st AS ({_STATS}), pr AS ({_PAIRS}),
d1 AS (SELECT st.*, place, CASE WHEN coverage < 0.3 THEN 'coverage' WHEN std < 1e-6 THEN 'variance' WHEN EXISTS (SELECT 1 FROM pr JOIN st e ON e.feature = pr.a WHERE pr.b = st.feature AND abs(r) > 0.8 AND e.coverage >= 0.3 AND e.std >= 1e-6) THEN 'correlation' END AS out FROM st JOIN fs USING (feature)),
d2 AS (SELECT *, count(*) FILTER (ic >= 0.02) OVER (PARTITION BY out IS NULL) AS good, row_number() OVER (PARTITION BY out IS NULL ORDER BY ic DESC NULLS LAST, place) AS rk FROM d1),
verdicts AS (SELECT feature, coalesce(out, CASE WHEN good >= 2 AND ic >= 0.02 OR good < 2 AND rk <= 2 THEN 'kept' ELSE 'ic' END) AS verdict FROM d2)"""
_OVERLAID = f"""{O}, uni AS (SELECT month_idx, industry, count(*) / sum(count(*)) OVER (PARTITION BY month_idx) AS wb FROM panel GROUP BY 1, 2),
ri AS (SELECT month_idx, industry, avg(target) AS rb FROM panel WHERE target IS NOT NULL GROUP BY 1, 2), rm AS (SELECT month_idx, avg(target) AS rm FROM panel WHERE target IS NOT NULL GROUP BY 1),
hh AS (SELECT f.seq AS month_idx, industry, 0.01::DOUBLE AS weight, target FROM f JOIN panel p ON p.entity = f.entity AND p.month_idx = f.seq WHERE NOT sold UNION ALL SELECT seq, 'CASH_POOL', count(*) * 0.01::DOUBLE, 0.025::DOUBLE / 12 FROM f WHERE sold GROUP BY 1),
po AS (SELECT month_idx, industry, sum(weight) AS w, coalesce(sum(weight * target) / sum(weight), 0) AS r FROM hh GROUP BY 1, 2),
br AS (SELECT po.*, industry = 'CASH_POOL' AS cash, coalesce(wb, 0) AS wb, coalesce(rb, 0) AS rb, coalesce(rm, 0) AS rm FROM po LEFT JOIN uni USING (month_idx, industry) LEFT JOIN ri USING (month_idx, industry) LEFT JOIN rm USING (month_idx))
SELECT 'overlay' AS series, month_idx, industry, round(w, 13) AS w_port, round(r, 13) AS r_port, round((w - wb) * (rb - rm), 13) AS allocation, round(CASE WHEN cash THEN 0 ELSE wb * (r - rb) END, 13) AS selection, round(CASE WHEN cash THEN 0 ELSE (w - wb) * (r - rb) END, 13) AS interaction FROM br"""
SQL = {
    "brinson_overlay": _OVERLAID,
    "screen_decisions": f"{_DECIDE} SELECT * FROM verdicts",
    "last_n_windows": f"WITH {PANEL_SQL} SELECT entity, month_idx, f_qty FROM panel0 WHERE month_idx IN (SELECT DISTINCT month_idx FROM panel0 ORDER BY 1 DESC LIMIT 60)",
    "window_summary": "SELECT factor, count(*) AS windows, round(avg(val_ic), 7) AS mean_val_ic, round(avg(gap), 7) AS mean_gap, round(avg(CAST(confidence = 'LOW' AS DOUBLE)), 7) AS low_share FROM (" + ALIGN["ic_gap"].replace("round(train_ic, 7) AS", "train_ic AS").replace("round(val_ic, 7) AS", "val_ic AS").replace("round(train_ic - val_ic, 7)", "train_ic - val_ic") + ") GROUP BY 1",
    "mode_schema": f"WITH {PANEL_SQL}, f AS (SELECT month_idx, " + " + ".join(f"CAST(count({c}) > 0 AS INTEGER)" for c in ("target", *FEATURES)) + " AS columns FROM panel GROUP BY 1), g AS (SELECT columns, count(*) AS months FROM f GROUP BY 1) SELECT columns, months, row_number() OVER (ORDER BY months DESC, columns DESC) = 1 AS expected FROM g",
    "monthly_rf": "WITH o AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month_idx, count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) SELECT month_idx, round(coalesce(CASE WHEN u % 2 = 0 THEN u / 10 / 100 END, CASE WHEN p % 3 <> 0 THEN p / 10 / 100 END, 0.025) / 12, 9) AS rf FROM o",
    "month_keys": f"WITH {PANEL_SQL} SELECT entity, pred_month, CASE WHEN f_count > 1 THEN industry ELSE '' END AS name, CAST(pred_month AS INTEGER) AS month_key FROM panel",
    "overlay_with_cash": f"{O} SELECT seq, entity::VARCHAR AS entity, 0.01::DOUBLE AS weight, label AS action, CAST(NULL AS DOUBLE) AS ret FROM f WHERE NOT sold UNION ALL SELECT seq, 'CASH_POOL', round(sum(0.01::DOUBLE), 8), 'CASH_POOL', round(0.025 / 12, 8)::DOUBLE FROM f WHERE sold GROUP BY seq",
    "holdings_view": f"{O}, s AS (SELECT *, round(0.01 * f_qty + 10 * f_disc - 5 * f_tax + f_count, 6) AS score, industry_l1 AS series FROM panel), h0 AS (SELECT *, count(*) OVER (PARTITION BY series, month_idx) AS n, row_number() OVER (PARTITION BY series, month_idx ORDER BY score DESC, entity) AS place FROM s) SELECT series, month_idx, h0.entity, CASE WHEN place <= 5 THEN 0.13 ELSE 0.07 END::DOUBLE AS weight, round(CASE WHEN place <= 5 THEN 0.13 ELSE 0.07 END::DOUBLE * target, 10) AS contribution, coalesce(f.label, 'HOLD') AS action FROM h0 LEFT JOIN f ON f.entity = h0.entity AND f.seq = h0.month_idx WHERE n >= 15 AND place <= 10",
    "validation_extras": f"""{M}, v1 AS (SELECT *, quantile_cont(net_return, 0.25) OVER (PARTITION BY series) AS q, count(*) OVER six AS c6, product(1 + net_return) OVER six - 1 AS r6, avg(excess_return) OVER six AS m6, stddev_samp(excess_return) OVER six AS s6, avg(net_return) OVER six AS n6, stddev_samp(CASE WHEN net_return < 0.0025 THEN net_return END) OVER six AS d6 FROM m WINDOW six AS (PARTITION BY series ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
v2 AS (SELECT series, count(*) AS months, avg(r6) FILTER (c6 = 6) AS rolling6m_return, avg(CASE WHEN d6 > 1e-8 THEN (n6 - 0.0025) / d6 ELSE 0 END) FILTER (c6 = 6) AS rolling6m_sortino, stddev_pop(CASE WHEN s6 > 1e-8 THEN m6 / s6 ELSE 0 END) FILTER (c6 = 6) AS ir_stability, avg(excess_return) AS excess_mean, avg(excess_return) * 12 AS annual_excess_mean, avg(CAST(excess_return > 0 AS DOUBLE)) AS pct_positive_excess,
 CASE WHEN stddev_samp(net_return) FILTER (net_return <= q) > 1e-8 THEN greatest(least(avg(net_return) FILTER (net_return <= q) / stddev_samp(net_return) FILTER (net_return <= q), 5.0), -5.0) ELSE 0 END AS worst_quartile, avg(turnover_cost) AS turnover_penalty FROM v1 GROUP BY 1)
SELECT series, months, """ + ", ".join(f"round(CASE WHEN months >= 6 THEN coalesce({c}, 0) ELSE 0 END, 6) AS {c}" for c in "rolling6m_return rolling6m_sortino ir_stability excess_mean annual_excess_mean pct_positive_excess worst_quartile turnover_penalty".split()) + " FROM v2",
    "trial_cap_params": "WITH p AS (SELECT p_partkey AS number, p_partkey % 10 / 100 AS lr, p_partkey % 900 AS n, p_size FROM part), c AS (SELECT *, greatest(lr, 0.005) AS rate, least(n, 500)::DOUBLE AS trees FROM p) SELECT number, 'first' AS member, 'learning_rate' AS name, rate AS value FROM c UNION ALL SELECT number, 'first', 'n_estimators', CASE WHEN rate * trees > 15 THEN greatest(floor(15 / rate), 100.0) ELSE trees END FROM c UNION ALL SELECT number, 'second', 'max_depth', least(p_size, 8)::DOUBLE FROM c UNION ALL SELECT number, 'shared', 'top', p_size::DOUBLE FROM c",
    "trial_quality_gate": f"WITH {TR} SELECT number, value FROM tr WHERE state = 'COMPLETE' AND NOT isn AND has AND value > -1500 AND x / 5 > 0.02 AND number % 7 <> 0 AND x * 3 < 1.2",
    "trial_verdict": f"WITH {TR}, q AS (SELECT count(*) AS qualified FROM tr WHERE state = 'COMPLETE' AND NOT isn AND has AND value > -1500 AND x / 5 > 0.02 AND number % 7 <> 0 AND x * 3 < 1.2) SELECT (SELECT count(*) FROM tr) AS trials, qualified, round(qualified / (SELECT count(*) FROM tr), 9) AS pass_rate, CASE WHEN qualified >= 30 AND qualified / (SELECT count(*) FROM tr) > 0.5 THEN 'GO' ELSE 'RERUN' END AS verdict FROM q",
    "trial_reuse": f"WITH {TR}, z AS (SELECT number, CASE WHEN has THEN 2 * (x / 5) - (x * x - 0.1) ELSE 0.0 END AS score FROM tr WHERE state = 'COMPLETE' AND p_type[1:5] = 'PROMO' AND p_size BETWEEN 5 AND 40) SELECT number, round(score, 9) AS score FROM z ORDER BY z.score, number LIMIT 10",
}
