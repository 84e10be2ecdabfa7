"""Operators on small literal inputs, and against numpy where SQL can't express them."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank, inv_norm
from tessera.operators import attribution, cross, factors, fundamentals, metrics, overlay, portfolio, scorers, selection, trials
from tessera.sources import ingest
from tessera.sources.tables import clean
from tessera.streaming import feeds


def test_inverse_normal(spark):
    ps = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-7]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inv_norm(F.col("p")).alias("q")).collect()
    assert all(abs(r.q - statistics.NormalDist().inv_cdf(r.p)) < 1e-9 for r in rows)


def test_ranks_average_ties_and_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, None)], "g int, x double")
    assert sorted((r.x is None, r.k or 0) for r in df.withColumn("k", avg_rank("x", "g")).collect()) == [(False, 1.0), (False, 2.5), (False, 2.5), (True, 0)]


def test_missing_values_become_null(spark):
    df = clean(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double"))
    assert sorted(r.x or 0 for r in df.collect()) == [0, 0, 0, 1.0]


def bars(spark, closes):
    import datetime

    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([("a", day + datetime.timedelta(i), c, c, c, c, 10.0, 10.0 * c, 0.01) for i, c in enumerate(closes)], "entity string, date date, open double, high double, low double, close double, volume double, amount double, turnover double")


def test_factor_needs_more_bars_than_its_window(spark):
    got = {n: factors.family(bars(spark, [1.0 + i for i in range(n)]), "minimum").orderBy(F.desc("date")).first() for n in (20, 21)}
    assert got[20].momentum_return_20d is None and got[21].momentum_return_20d == 20.0


def test_flat_window_and_convention(spark):
    flat = factors.family(bars(spark, [2.0] * 30), "momentum").orderBy(F.desc("date")).first()
    assert flat.momentum_rsi_14d == 50.0 and flat.momentum_price_position_20d == 0.5 and flat.momentum_sharpe_20d is None
    up, down = (factors.family(bars(spark, [1.0 + i for i in range(30)]), "momentum", c).orderBy(F.desc("date")).first().momentum_rsi_14d for c in ("chronological", "reference"))
    assert up == 100.0 and down == 0.0


def test_ema_is_recursive(spark):
    xs = [1.0, 4.0, 2.0, 8.0]
    e, want = None, []
    for x in xs:
        e = x if e is None else e * (1 - 2 / 13) + x * 2 / 13
        want.append(round(e, 6))
    assert [r.ema_12 for r in factors.ema(bars(spark, xs)).orderBy("date").collect()] == want


def cells(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(1, "f", i, float(rng.normal() + (i % 4)) if i % 9 else None, float(math.exp(rng.normal(5, 1))), f"ind{i % 4}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "month_idx int, factor string, entity int, y double, market_cap double, industry string")


def test_scheme_a_residual_is_least_squares(spark):
    rows, df = cells(spark)
    got = {r.entity: r.e for r in cross.neutralize(df, "a").collect()}
    x = np.array([[1, math.log(r[4]), *[float(r[5] == f"ind{k}") for k in (1, 2, 3)]] for r in rows])
    y = np.array([r[3] or 0.0 for r in rows])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert max(abs(e[r[2]] - got[r[2]]) for r in rows) < 1e-9


def test_missing_size_keeps_the_standardised_factor(spark):
    rows, df = cells(spark)
    df = df.withColumn("market_cap", F.when(F.col("entity") != 7, F.col("market_cap")))
    y = np.array([r[3] or 0.0 for r in rows])
    got = {r.entity: r.z for r in cross.neutralize(df, "a").collect()}
    assert max(abs((y[r[2]] - y.mean()) / y.std() - got[r[2]]) for r in rows) < 1e-9


def test_scheme_b1_residual_is_least_squares(spark):
    rows, df = cells(spark)
    got = {r.entity: r.e for r in cross.neutralize(df, "b1").collect()}
    known = {r.entity: r.y for r in cross.rank_normal(df, 2).collect()}
    s = np.log([r[4] for r in rows])
    s = s - s.mean()
    x = np.column_stack([np.ones(len(rows)), s, s**2, s**3, *[[float(r[5] == f"ind{k}") for r in rows] for k in (1, 2, 3)]])
    y = np.array([known[r[2]] or 0.0 for r in rows])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert max(abs(e[r[2]] - got[r[2]]) for r in rows if r[3] is not None) < 1e-6
    assert all(got[r[2]] is None for r in rows if r[3] is None)


def normal_scores(values):
    """Inverse normal of (average rank - 0.5) / n; missing values 0."""
    known = sorted(v for v in values if v is not None)
    rank = lambda v: (known.index(v) + 1 + len(known) - known[::-1].index(v)) / 2
    return np.array([0.0 if v is None else statistics.NormalDist().inv_cdf((rank(v) - 0.5) / len(known)) for v in values])


def test_scheme_f_is_least_squares_on_styles(spark):
    rng = np.random.default_rng(4)
    n = 90
    opt = lambda x, k: None if k % 11 == 3 else round(float(x), 3)
    rows = [(1, i, float(np.exp(rng.normal(5, 1))), f"ind{i % 3}" if i % 13 else None, opt(rng.normal(), i), opt(rng.normal() ** 2, i + 1), opt(rng.normal(), i + 2)) for i in range(n)]
    exposures = spark.createDataFrame(rows, "month_idx int, entity int, market_cap double, industry string, momentum_20d double, beta_60d double, other double")
    assert cross.style_columns(exposures.columns) == ["momentum_20d", "beta_60d"]
    got = {(r.factor, r.entity): r for r in cross.neutralize(cross.long_form(exposures, ["other", "beta_60d"], ["month_idx", "entity"]), "f", exposures).collect()}
    assert {k[0] for k in got} == {"other", "momentum_20d", "beta_60d"} and len(got) == 3 * n
    y = {"momentum_20d": normal_scores([r[4] for r in rows]), "beta_60d": normal_scores([r[5] for r in rows]), "other": normal_scores([r[6] for r in rows])}
    ind = [r[3] or "ind0" for r in rows]
    x = np.column_stack([np.ones(n), np.log([r[2] for r in rows]), *[[float(k == f"ind{j}") for k in ind] for j in (1, 2)], y["momentum_20d"], y["beta_60d"]])
    for factor, at in (("other", 6), ("momentum_20d", 4), ("beta_60d", 5)):
        e = y[factor] - x @ np.linalg.lstsq(x, y[factor], rcond=1e-5)[0]
        assert all((got[factor, r[1]].e is None) if r[at] is None else abs(got[factor, r[1]].e - e[r[1]]) < 1e-8 for r in rows)
    assert all(r.z in (0.0, None) for k, r in got.items() if k[0] != "other")  # a style explains itself


@pytest.mark.parametrize("alignment", ["drop", "impute"])
def test_scheme_g_is_least_squares_on_components(spark, alignment):
    rng = np.random.default_rng(1)
    n, places = 60, 8
    m = rng.normal(size=(n, places)) * np.linspace(3, 0.5, places)
    vectors = [(mon, i, [None if (i, k) in ((5, 2), (9, 0)) else float(m[i, k] * mon) for k in range(places)]) for mon in (1, 2) for i in range(n - 2)]
    rows = [(mon, "f", i, None if i % 9 == 0 else float(rng.normal())) for mon in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "month_idx int, factor string, entity int, y double")
    returns = spark.createDataFrame(vectors, "month_idx int, entity int, returns array<double>")
    got = {(r.month_idx, r.entity): r for r in cross.neutralize(df, "g", returns, 3, alignment, places).collect()}
    assert len(got) == 2 * n
    for mon in (1, 2):
        y = normal_scores([r[3] for r in rows if r[0] == mon])
        r = np.full((n, places), np.nan)
        for mo, i, v in vectors:
            if mo == mon:
                r[i] = [np.nan if x is None else x for x in v]
        if alignment == "impute":
            r = np.where(np.isnan(r), np.nanmedian(r, axis=0), r)
        known = ~np.isnan(r).any(1)
        c = r[known] - r[known].mean(0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        x = np.column_stack([np.ones(known.sum()), u[:, :3] * s[:3]])
        e = np.full(n, np.nan)
        e[known] = y[known] - x @ np.linalg.lstsq(x, y[known], rcond=1e-5)[0]
        for i in range(n):
            assert (got[mon, i].e is None) if not known[i] or i % 9 == 0 else abs(got[mon, i].e - e[i]) < 1e-8
        assert known.sum() == (n if alignment == "impute" else n - 4)


def test_order_statistics_by_histograms(spark, monkeypatch):
    monkeypatch.setattr(trials, "BINS", 4)
    rng = np.random.default_rng(8)
    values = [float(v) for v in np.round(rng.normal(size=200) ** 3, 1)] + [1e12, -998.0, 3.5, 3.5, 3.5]
    rows = [(int(i), "COMPLETE", v, {"a": "1"}, {}) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "number bigint, state string, value double, params map<string,string>, attrs map<string,double>").repartition(3)
    for k in (1, 7, 100, 205):
        assert trials.kth(df, "value", k) == sorted(values)[k - 1]
    for ascending in (True, False):
        order = sorted(range(len(values)), key=lambda i: (values[i] if ascending else -values[i], i))
        assert sorted(r.number for r in trials.best_share(df, 0.3, ascending).collect()) == sorted(order[:61])
    assert trials.best_share(df.limit(0), 0.3).collect() == [] and trials.convergence(df.limit(0)).collect() == []


def test_unknown_scheme_and_missing_style(spark):
    _, df = cells(spark)
    with pytest.raises(ValueError):
        cross.neutralize(df, "zz")
    with pytest.raises(ValueError):
        cross.neutralize_f(df, df, ["absent"])
    with pytest.raises(ValueError):
        cross.neutralize_f(df, df)


def test_five_factor_is_ridge(spark):
    rng = np.random.default_rng(2)
    f, e = rng.normal(size=(10, 2)), rng.normal(size=10)
    df = spark.createDataFrame([("s", i, float(f[i, 0]), float(f[i, 1]), float(e[i])) for i in range(10)], "series string, month_idx int, a double, b double, excess double")
    rows = attribution.factor_regression(df, ["a", "b"]).orderBy("month_idx").collect()
    x = np.column_stack([np.ones(10), f])
    want = np.linalg.solve(x.T @ x + 0.01 * np.eye(3), x.T @ e)
    assert abs(rows[-1].beta_a - want[1]) < 1e-9 and abs(rows[-1].alpha - want[0] * 12) < 1e-9 and rows[4].alpha == 0.0


def holdings(spark, rows):
    return spark.createDataFrame([(*r, 0.1) for r in rows], "entity bigint, seq int, ts double, ei double, weight double")


def test_overlay_rules(spark):
    rows = [(1, 1, 0.5, 0.1), (1, 2, 0.5, -0.02), (1, 3, 0.9, -0.2), (2, 1, -0.9, 0.5), (2, 2, 0.4, 0.1), (3, 1, 0.2, 0.1), (3, 3, 0.3, -0.1)]
    got = {(r.entity, r.seq): r for r in overlay.run(holdings(spark, rows)).collect()}
    assert (got[1, 2].sign, got[1, 2].ats) == (1, 0.5)  # inside the band
    assert (got[1, 3].sign, got[1, 3].ats) == (-1, 0.9)  # crossed
    assert got[2, 1].sold and got[2, 1].label == "SELL" and got[2, 2].label == "REENTER" and got[2, 2].ats == 0.4
    assert (got[3, 3].sign, got[3, 3].label) == (-1, "HOLD")  # absent in between: new
    assert overlay.cash_pool(overlay.run(holdings(spark, rows))).first().cash_weight == 0.1


def test_overlay_stream_equals_batch(spark):
    """In three deliveries, some months late, some absent; then on from a given state."""
    rng = np.random.default_rng(5)
    df = holdings(spark, [(i, m, float(rng.uniform(-1, 1)), float(rng.uniform(-1, 1))) for i in range(6) for m in range(1, 9) if (i + m) % 5])
    want = sorted(feeds.rounded_overlay(overlay.run(df)).collect())
    late = (F.col("seq") == 4) & (F.col("entity") % 2 == 0)
    parts = [(F.col("seq") <= 5) & ~late, late | F.col("seq").between(6, 7), F.col("seq") > 7]
    assert sorted(feeds.rounded_overlay(feeds.stream_overlay(spark, df, parts)).collect()) == want
    state = overlay.run(df.filter("seq <= 4")).filter("seq = 4").select("entity", "seq", "sign", "ats", "sold")
    got = feeds.stream_overlay(spark, df.filter("seq > 4"), initial=state)
    assert sorted(feeds.rounded_overlay(got).collect()) == [r for r in want if r.seq > 4]


def test_too_few_months(spark):
    with pytest.raises(ValueError):
        portfolio.rolling_windows(spark.createDataFrame([(i,) for i in range(10)], "month_idx int"))


def test_portfolio_breaks_ties_by_entity_and_skips_thin_months(spark):
    df = spark.createDataFrame([(e, 1, 1.0) for e in range(16)] + [(e, 2, 1.0) for e in range(14)], "entity int, month_idx int, score double")
    rows = portfolio.build_portfolio(df).orderBy("place").collect()
    assert [r.entity for r in rows] == list(range(16)) and abs(sum(r.weight for r in rows) - 1) < 1e-9


def test_short_series_measures(spark):
    df = spark.createDataFrame([("s", i, r, 0.0, r, 0.0, r) for i, r in enumerate([0.1, -0.1, 0.05])], "series string, month_idx int, portfolio_return double, benchmark_return double, excess_return double, turnover_cost double, net_return double")
    m = metrics.measures(df).first()
    assert abs(m.max_drawdown + 0.1) < 1e-9 and m.jensen_alpha == 0.0 and m.rolling6m_ir == 0.0 and m.up_capture == 0.0


def test_align_and_asof(spark):
    a = spark.createDataFrame([(1, 2)], "x int, z int")
    assert ingest.align_schema(a, spark.createDataFrame([(1, "q")], "y int, x string")).columns == ["y", "x", "z"]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, 7.0), (1, 5, 9.0)], "k int, a int, value double")
    assert sorted((r.k, r.t, r.value or 0) for r in ingest.asof(left, right, "k", "t", "a").collect()) == [(1, 1, 0), (1, 5, 9.0), (2, 5, 0)]


def test_scorer_covers_every_window(spark, monkeypatch):
    from tessera.plans import live

    rows = [(e, m, float(e * m % 7), float((e + m) % 5)) for m in range(6) for e in range(20)]
    df = spark.createDataFrame(rows, "entity int, month_idx int, x double, target double")
    windows, fit = portfolio.rolling_windows(df, 2, 1, 1), live.scorers.train_and_score
    monkeypatch.setattr(live, "FEATURES", ["x"])
    monkeypatch.setattr(live, "panel", lambda s, d: df)
    monkeypatch.setattr(live, "with_target", lambda x: x)
    monkeypatch.setattr(live.portfolio, "rolling_windows", lambda x: windows)
    monkeypatch.setattr(live.scorers, "train_and_score", lambda df, features: fit(df, features, trees=1, depth=1))
    got = live.QUERIES["train_scorer"](spark, "").collect()
    assert sorted((r.month_idx, r.entity) for r in got) == [(m, e) for m in (3, 4, 5) for e in range(20)]
    assert {(r.window_id, r.month_idx) for r in got} == {(0, 3), (1, 4), (2, 5)}


def test_scorer_deals_rows_evenly(spark, monkeypatch):
    """Windows met rows as ranks had left them, whole months in one task."""
    from tessera.operators import scorers

    monkeypatch.setattr(scorers, "ROWS", 50)
    df = portfolio.label_rank(spark.range(1200).selectExpr("id entity", "cast(id % 2 as int) month_idx", "cast(id % 17 as double) target"))
    sizes, windows = [], spark.createDataFrame([(0, 0, "train"), (0, 1, "test")], "window_id bigint, month_idx int, split string")
    monkeypatch.setattr(scorers, "train_and_score", lambda rows, features: sizes.extend(rows.rdd.glom().map(len).collect()) or rows)
    scorers.train_windows(df, windows, [])
    assert sum(sizes) == 1200 and len(sizes) >= 24 and max(sizes) < 120


def test_month_ends_agree_with_every_bar(spark):
    df = bars(spark, [10 + math.sin(i) + i / 50 for i in range(150)])
    for name in ("risk", "alpha", "composite"):
        ends = {r.date: r for r in factors.family(df, name).collect()}
        every = {r.date: r for r in factors.family(df, name, month_ends=False).collect()}
        assert len(every) == 150 and ends and all(every[d] == r for d, r in ends.items())


def test_screen_is_fitted_once_and_applied_later(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a := rng.normal()), float(a + 0.01 * rng.normal()), 1.0, float(rng.normal()) if i % 5 == 0 else None, float(a + rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "entity int, good double, twin double, flat double, sparse double, target double")
    features = ["good", "twin", "flat", "sparse"]
    got = {r.feature: r.verdict for r in selection.decide(df, features, min_keep=1).collect()}
    assert got == {"good": "kept", "twin": "correlation", "flat": "variance", "sparse": "coverage"}
    screen = selection.Screen.fit(df, features, min_keep=1)
    assert screen.features == ["good"] and screen.apply(df.limit(3), ["entity"]).columns == ["entity", "good"]


def test_macro_drops_zeros_of_thin_months(spark):
    macro = spark.createDataFrame([(1, "a", 0.0), (1, "b", 2.0), (2, "a", float("inf")), (2, "b", 1.0)], "month_idx int, key string, value double")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "month_idx int")
    got = {r.month_idx: (r.macro_a, r.macro_b) for r in fundamentals.join_macro(rows, macro, ["a", "b"]).collect()}
    assert got == {1: (None, 2.0), 2: (None, 1.0), 3: (None, None)}
    assert fundamentals.join_macro(rows, macro, ["a"], full=2).filter("month_idx = 1").first().macro_a == 0.0


def test_recursive_averages_cross_blocks(spark):
    rng = np.random.default_rng(5)
    x = {e: 100 + rng.normal(size=n).cumsum() for e, n in (("long", 3 * factors.BLOCK + 7), ("whole", factors.BLOCK), ("one", 1))}
    day = np.datetime64("2000-01-01")
    rows = [(e, (day + i).astype(object), float(v)) for e, vs in x.items() for i, v in enumerate(vs)]
    got = factors.ema(spark.createDataFrame(rows, "entity string, date date, close double")).toPandas().sort_values(["entity", "date"])
    for e, vs in x.items():
        mine, closes = got[got.entity == e], pd.Series(vs)
        mean = lambda s, span: s.ewm(span=span, adjust=False).mean()
        dif = mean(closes, 12) - mean(closes, 26)
        for name, want in (("ema_12", mean(closes, 12)), ("ema_200", mean(closes, 200)), ("dif", dif), ("dea", mean(dif, 9))):
            assert np.allclose(mine[name].to_numpy(), want.to_numpy(), atol=1e-4), (e, name)
    assert factors.ema(spark.createDataFrame([], "entity string, date date, close double")).count() == 0


def test_fill_and_schema_problems(spark):
    df = spark.createDataFrame([(1, 10, None, "x"), (1, 11, 2.0, "y"), (2, 10, None, "z")], "entity int, month_idx int, a double, extra string")
    ref = spark.createDataFrame([(10, 1, 5.0, 7), (11, 1, 6.0, 8)], "month_idx int, entity int, a double, b int")
    out = ingest.fill_cells(df, ref, ["entity", "month_idx"])
    assert out.columns == ["month_idx", "entity", "a", "b", "extra"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(10, 1, 5.0, 7, "x"), (11, 1, 2.0, 8, "y"), (10, 2, None, None, "z")], key=str)
    assert ingest.schema_problems(ref, ref, ["entity"]) == []
    found = ingest.schema_problems(df.withColumn("a", df["a"].cast("float")), ref, ["entity", "industry"])
    assert found == ["absent: industry", "order", "type of a: float, not double"]


def test_windows_are_trained_side_by_side(spark):
    rng = np.random.default_rng(3)
    rows = [(e, m, float(rng.normal()), float(rng.random())) for m in range(4) for e in range(30)]
    df = spark.createDataFrame(rows, "entity int, month_idx int, f double, label_rank double")
    windows = spark.createDataFrame([(w, w + i, s) for w in range(2) for i, s in enumerate(("train", "valid", "test"))], "window_id int, month_idx int, split string")
    got = {p: sorted((r.window_id, r.entity, round(r.score, 9)) for r in scorers.train_windows(df, windows, ["f"], parallelism=p, trees=2, depth=2).collect()) for p in (1, 3)}
    assert got[1] == got[3] and {w for w, *_ in got[1]} == {0, 1} and len(got[1]) == 60
