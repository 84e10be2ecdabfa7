"""Forests of all windows against Spark ML's trees on the same bootstrap weights."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tessera.operators import boosting, forest, scorers


@pytest.fixture(scope="module")
def table(spark):
    """Three windows; few values a feature, so that bins are the values; some labels and features are missing."""
    rng = np.random.default_rng(7)
    rows = [(e, m, float(e % 5), float(rng.integers(0, 4)), float(rng.integers(0, 3))) for m in range(6) for e in range(120)]
    df = spark.createDataFrame(rows, "entity bigint, month_idx int, a double, b double, c double")
    noise = F.pmod(F.xxhash64("entity", "month_idx"), F.lit(100)) / 400
    df = df.withColumn("label_rank", F.when(F.col("entity") % 11 != 3, F.col("a") * F.col("b") / 15 + F.when(F.col("c") > 1, 0.3).otherwise(0.0) + noise))
    df = df.withColumn("c", F.when(F.col("c") != 0, F.col("c")))
    windows = spark.createDataFrame([(w, w + i, k) for w in range(3) for i, k in enumerate(["train", "train", "valid", "test"])], "window_id bigint, month_idx int, split string")
    return df, windows


def test_trees_are_spark_mls_on_the_same_samples(spark, table, monkeypatch):
    monkeypatch.setattr(forest, "_candidates", lambda n, *_: set(range(n)))
    df, windows = table
    features, trees, depth = ["a", "b", "c"], 3, 3
    got = {(r.window_id, r.entity): r.score_b for r in scorers.score_windows(df, windows, features, trees=trees, depth=depth).collect()}
    rows = VectorAssembler(inputCols=features, outputCol="x").transform(df.fillna(0.0, features)).join(windows, "month_idx")
    known = rows.filter("label_rank is not null and split = 'train'").collect()
    keys = [boosting._mixed(np.array([r.entity for r in known], np.int64)), boosting._mixed(np.array([r.month_idx for r in known], np.int32))]
    want: dict = {}
    for t in range(trees):
        weights = boosting._bagged(keys, t, 1)
        assert weights.min() == 0 and weights.max() > 1
        fit = spark.createDataFrame([(r.window_id, r.x, r.label_rank, float(v)) for r, v in zip(known, weights) if v > 0], ["window_id", "x", "label_rank", "weight"])
        for w in range(3):
            tree = DecisionTreeRegressor(featuresCol="x", labelCol="label_rank", weightCol="weight", maxDepth=depth).fit(fit.filter(F.col("window_id") == w))
            for r in tree.transform(rows.filter(f"split = 'test' and window_id = {w}")).collect():
                want[w, r.entity] = want.get((w, r.entity), 0.0) + r.prediction / trees
    assert got.keys() == want.keys() and len({round(v, 9) for v in got.values()}) > 20
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_windows_are_trained_together(spark, table, monkeypatch):
    """Each window was a training of its own, with its own copy of the rows."""
    df, windows = table
    passes, add, writes, write = [], boosting.added, [], boosting.written
    monkeypatch.setattr(boosting, "added", lambda *a: passes.append(1) or add(*a))
    monkeypatch.setattr(boosting, "written", lambda rows: writes.append(1) or write(rows))
    sizes = []
    for n in (1, 3):
        scores = scorers.score_windows(df, windows.filter(F.col("window_id") < n), ["a", "b"], trees=1, depth=1).collect()
        assert len(scores) == n * 120 and all(abs(r.score - (r.score_a + r.score_b) / 2) < 1e-12 for r in scores)
        sizes.append((len(passes), len(writes)))
    assert sizes[1] == (2 * sizes[0][0], 2 * sizes[0][1])


def test_other_partitions_give_the_same_forest(spark, table):
    df, windows = table
    one, two = ({(r.window_id, r.entity): (r.score_a, r.score_b) for r in scorers.score_windows(d, windows, ["a", "b", "c"], trees=2, depth=2).collect()} for d in (df, df.repartition(7, "entity")))
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], rtol=0, atol=1e-12) for k in one)


def test_windows_without_labels_have_no_forest(spark, table):
    df, windows = table
    rows = scorers.score_windows(df.withColumn("label_rank", F.lit(None).cast("double")), windows, ["a"], trees=1, depth=1).collect()
    assert len(rows) == 360 and {(r.score_a, r.score_b, r.score) for r in rows} == {(None, None, None)}
