"""Trained scorers on rolling windows."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, forest
from .portfolio import blend

#: Rows of a dealt partition at most, so that no task reads more as tables grow.
ROWS = 1_000_000


def dealt(df: DataFrame, keys: tuple[str, ...], rows: int) -> DataFrame:
    """df dealt evenly by its keys: the session's number of partitions, or more where they would hold over ROWS of so many rows."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *keys)


def train_and_score(df: DataFrame, features: list[str], label: str = "label_rank", weight: float = 0.5, trees: int = 10, depth: int = 3, seed: int = 1, keys: tuple[str, ...] = ("entity", "month_idx")) -> DataFrame:
    """Scores of the test rows of one window (split train, valid, test) by boosted trees with early stopping, a random forest, and their blend.

    Training rows are dealt and sorted by their keys: samples are drawn by place, so reruns and lost executors draw the same ones.
    """
    df = VectorAssembler(inputCols=features, outputCol="_x").transform(df.fillna(0.0, features))
    fit = df.filter(f"split <> 'test' and {label} is not null").withColumn("_valid", F.col("split") == "valid").select("_x", label, "_valid", *keys)
    fit = dealt(fit, keys, fit.count()).sortWithinPartitions(*keys).select("_x", label, "_valid").cache()
    boosted = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="score_a", lossType="absolute", maxIter=trees, maxDepth=depth, subsamplingRate=0.8, validationIndicatorCol="_valid", seed=seed).fit(fit)
    forest = RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol="score_b", numTrees=trees, maxDepth=depth, seed=seed).fit(fit.filter("not _valid"))
    fit.unpersist()
    return blend(forest.transform(boosted.transform(df.filter("split = 'test'"))), weight).drop("_x")


def train_windows(df: DataFrame, windows: DataFrame, features: list[str], parallelism: int = 4, **options) -> DataFrame:
    """Scores of the test rows of every window of (window_id, month_idx, split), with window_id, by the estimators of Spark ML; one job set a window, some at a time: for few windows."""
    keys = options.get("keys", ("entity", "month_idx"))
    df = dealt(df, keys, df.count()).persist()  # read by all windows; whole months would lie in one task after ranks
    windows = windows.sparkSession.createDataFrame(windows.collect(), windows.schema)  # windows times months; joined by broadcast, as a shuffle would put whole months in one task
    ids = sorted(r.window_id for r in windows.select("window_id").distinct().collect())
    one = lambda i: train_and_score(df.join(F.broadcast(windows.filter(F.col("window_id") == i)), "month_idx"), features, **options)
    with ThreadPool(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(one), ids))


def score_windows(df: DataFrame, windows: DataFrame, features: list[str], label: str = "label_rank", weight: float = 0.5, trees: int = 10, depth: int = 3, seed: int = 1, keys: tuple[str, ...] = ("entity", "month_idx")) -> DataFrame:
    """Scores of the test rows of every window by boosted trees with early stopping, a random forest, and their blend.

    Trees of all windows grow together on rows that are stored once (see `boosting` and `forest`), where `train_windows`
    makes some hundred jobs and a copy of its rows for each window.
    """
    s = boosting.Settings(rounds=trees, depth=depth, seed=seed)
    given = data, model = boosting.stored(df, windows, features, label, s, list(keys), bagged=trees)
    boosting.fit_windows(df, windows, features, label, s, keys, given)
    grown = forest.fit(data, model, trees, depth, s.bins, seed)
    data.packed.unpersist()
    return blend(boosting._scores(data, model, "test", {"score_a": model.final, "score_b": grown.score}), weight)


def importance(model, features: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(f, float(model.featureImportances[i])) for i, f in enumerate(features)], "feature string, importance double")

