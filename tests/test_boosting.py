"""Boosted windows on tables with a known optimum; trials that go on after a break."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.boosting import Settings

ALL = Settings(rounds=3, depth=1, rate=1.0, rows=1.0, columns=1.0, least=5, bins=8, decay_every=100, alpha=0.0)


@pytest.fixture(scope="module")
def table(spark):
    """Two windows of two training, one validation and one test month; the label is a step of b, a is noise."""
    rng = np.random.default_rng(3)
    rows = [(e, m, float(rng.normal()), float(e % 8)) for m in range(5) for e in range(64)]
    df = spark.createDataFrame(rows, "entity bigint, month_idx int, a double, b double").withColumn("label_rank", F.when(F.col("b") > 3, 0.9).otherwise(0.1))
    df = df.withColumn("label_rank", F.when((F.col("entity") != 5) | (F.col("month_idx") != 0), F.col("label_rank"))).withColumn("b", F.when(F.col("b") != 0, F.col("b")))
    windows = spark.createDataFrame([(w, w + i, k) for w in (0, 1) for i, k in enumerate(["train", "train", "valid", "test"])], "window_id int, month_idx int, split string")
    return df, windows


def test_a_step_is_found(spark, table):
    scores, importances, history = boosting.fit_windows(*table, ["a", "b"], settings=ALL)
    rows = scores.collect()
    assert len(rows) == 2 * 2 * 64 and all(abs(r.score - (0.9 if r.entity % 8 > 3 else 0.1)) < 1e-12 for r in rows)
    gain = {(r.window_id, r.feature): r.gain for r in importances.collect()}
    assert gain[0, "b"] > 0 and gain[1, "b"] > 0 and gain[0, "a"] == gain[1, "a"] == 0
    assert all(r.error < 1e-12 for r in history.filter("stage > 0").collect())


def test_rate_decays_in_steps_to_a_floor():
    s = Settings(rate=0.2, decay_every=2, decay=0.5, rate_floor=0.1)
    assert [round(s.rate_at(i), 9) for i in range(10)] == [0.2, 0.2, 0.1, 0.1, 0.05, 0.05, 0.025, 0.025, 0.02, 0.02]


def test_scores_follow_the_decayed_rates(spark, table):
    """Each stage takes the rate's share of what is left of the median residual."""
    s = Settings(**{**ALL.__dict__, "rate": 0.5, "decay_every": 1, "decay": 0.5, "rounds": 3})
    scores = boosting.fit_windows(*table, ["b"], settings=s)[0].filter("window_id = 1 and split = 'test'").collect()
    base = 0.1 if {round(r.score, 3) for r in scores if r.entity % 8 <= 3} == {0.1} else 0.9
    left = 0.8
    for rate in (0.5, 0.25, 0.125):
        left *= 1 - rate
    far = [r.score for r in scores if (r.entity % 8 > 3) == (base == 0.1)]
    assert far and all(abs(abs(x - base) - (0.8 - left)) < 1e-9 or abs(x - 0.5) < 0.41 for x in far)


def test_stops_early_where_validation_gets_worse(spark, table):
    df, windows = table
    turned = df.withColumn("label_rank", F.when(F.col("month_idx") == 2, 1 - F.col("label_rank")).otherwise(F.col("label_rank")))
    scores, importances, history = boosting.fit_windows(turned, windows.filter("window_id = 0"), ["a", "b"], settings=Settings(**{**ALL.__dict__, "patience": 2, "rounds": 9}))
    assert {r.score for r in scores.collect()} in ({0.1}, {0.9}, {0.5})  # the median of the labels
    assert history.agg(F.max("stage")).first()[0] == 2 and importances.agg(F.sum("gain")).first()[0] == 0.0


def test_reruns_and_other_partitions_give_the_same(spark, table):
    df, windows = table
    s = Settings(rounds=2, depth=2, least=4)
    one, two = (sorted(map(tuple, boosting.fit_windows(d, windows, ["a", "b"], settings=s)[0].collect()), key=str) for d in (df, df.repartition(7, "entity")))
    assert one == two


def test_trials_go_on_after_a_break(spark, table, tmp_path, monkeypatch):
    grid, at, fitted = [ALL, Settings(rounds=1, least=4)], f"{tmp_path}/results", []
    fit = boosting.fit_windows
    monkeypatch.setattr(boosting, "fit_windows", lambda *a: fitted.append(a[4]) or fit(*a))
    first = boosting.run_trials(*table, ["a", "b"], grid[:1], at)
    assert {(r.number, r.window_id) for r in first.collect()} == {(0, 0), (0, 1)} and all(r.error < 1e-12 for r in first.collect())
    rows = boosting.run_trials(*table, ["a", "b"], grid, at).collect()
    assert {(r.number, r.window_id) for r in rows} == {(n, w) for n in (0, 1) for w in (0, 1)} and fitted == grid


def test_windows_without_labels_score_null(spark, table):
    df, windows = table
    scores, _, history = boosting.fit_windows(df.withColumn("label_rank", F.lit(None).cast("double")), windows, ["a"], settings=ALL)
    assert {r.score for r in scores.collect()} == {None} and history.collect() == []


def test_rows_are_stored_once_whatever_the_windows(spark, table, monkeypatch):
    """They were written again for each window and stage."""
    df, windows = table
    sizes, write = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda rows: sizes.append((out := write(rows)).count()) or out)
    boosting.fit_windows(df, windows, ["a", "b"], settings=Settings(rounds=2, depth=1, least=4))
    assert sizes == [5 * 64] * 2


def test_medians_are_exact_in_narrow_cells(spark, monkeypatch):
    """Far values put all others in one cell, so that ranges are narrowed; ties, an even count and a single row."""
    monkeypatch.setattr(boosting, "CELLS", 4)
    monkeypatch.setattr(boosting, "FEW", 3)
    labels = {0: [0.1 * i for i in range(40)] + [1e6], 1: [0.5] * 30 + [-9.0, 0.7], 2: [1.0, 2.0, 4.0, 1e9], 3: [7.0]}
    rows = [(w * 100 + i, w, 0.0, y) for w, ys in labels.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "entity bigint, month_idx int, a double, label_rank double")
    windows = spark.createDataFrame([(w, w, "train") for w in labels], "window_id int, month_idx int, split string")
    data, model = boosting.stored(df, windows, ["a"], "label_rank", ALL, ["entity", "month_idx"])
    got = boosting._medians(data, model, set(labels), {}, 0, lambda w, k: np.ones(len(k[0][0]), bool), dict.fromkeys(labels, (-9.0, 1e9)))
    assert {w: v for (w, _), v in got.items()} == {w: float(np.median(ys)) for w, ys in labels.items()}


def test_draws_are_those_of_sparks_hash(spark):
    rows = spark.range(500).selectExpr("id * 7919 - 900 entity", "cast(id % 90 - 5 as int) month_idx")
    got = rows.withColumn("d", F.pmod(F.xxhash64(F.lit(3).cast("bigint"), "entity", "month_idx", F.lit(2), F.lit(1)), F.lit(10_000)) < 8000).collect()
    keys = [boosting._mixed(np.array([r.entity for r in got], np.int64)), boosting._mixed(np.array([r.month_idx for r in got], np.int32))]
    assert boosting._drawn(3, keys, 2, Settings()).tolist() == [r.d for r in got]


def test_trials_store_rows_once_and_are_judged_by_ranks(spark, table, tmp_path, monkeypatch):
    """Each candidate stored the rows anew, and rows were sorted for each window."""
    df, windows = table
    grid, writes, write = [Settings(rounds=2, depth=2, least=4), Settings(rounds=1, depth=1, least=4)], [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda rows: writes.append(1) or write(rows))
    got = {(r.number, r.window_id): r for r in boosting.run_trials(*table, ["a", "b"], grid, f"{tmp_path}/results").collect()}
    assert len(got) == 4 and len(writes) == 2
    for number, settings in enumerate(grid):
        scores = boosting.fit_windows(df, windows, ["a", "b"], settings=settings)[0].filter("split = 'valid'").toPandas()
        for w, rows in scores.groupby("window_id"):
            months = [m.score.rank().corr(m.y.rank()) for _, m in rows.groupby("month_idx")]
            assert abs(got[number, w].ic - np.mean(np.nan_to_num(months))) < 1e-9 and abs(got[number, w].error - (rows.y - rows.score).abs().mean()) < 1e-9


def test_draws_are_the_same_in_more_columns_and_later_stages(spark, table, monkeypatch):
    """A bit a window and stage; stages beyond those stored are drawn in each pass."""
    df, windows = table
    s = Settings(rounds=3, depth=2, least=4)
    fit = lambda: sorted(map(tuple, boosting.fit_windows(df, windows, ["a", "b"], settings=s)[0].collect()), key=str)
    want = fit()
    monkeypatch.setattr(boosting, "BITS", 1)
    monkeypatch.setattr(boosting, "STAGES", 1)
    assert fit() == want
