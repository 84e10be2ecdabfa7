"""Random forests for all rolling windows at once, on the rows that boosting stores.

A tree's bootstrap sample gives each row a Poisson weight by a hash of its keys and the tree, the same in every window
that it trains. Squared error needs sums alone, so rows of a month with equal features are one cell, with the sums of
their weights and of weights times labels for every tree. A level of all trees of all windows is one pass over the cells.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import boosting
from .boosting import Model, Stored


class Forest:
    """Trees of each window as (splits, values of the leaves)."""

    def __init__(self, trees: dict[int, list[tuple[dict, np.ndarray]]]):
        self.trees = trees

    def score(self, window: int, codes: list[np.ndarray]) -> np.ndarray | None:
        """The mean of the trees; None for a window without training rows."""
        trees = self.trees.get(window, [])
        return sum(boosting._node(codes, splits, len(values).bit_length() - 1, values) for splits, values in trees) / len(trees) if trees else None


def _candidates(n: int, tree: int, node: int, seed: int) -> set[int]:
    """The third of the features that a node may be split by."""
    return set(random.Random(f"{seed} {tree} {node}").sample(range(n), -(-n // 3)))


def _histogram(data: Stored, model: Model, grown: dict, level: int, trees: int, bins: int, seed: int) -> DataFrame:
    """Sums of weights times labels and of weights by window, tree, node, feature and bin."""
    first, n, places = 1 << level, len(data.edges), {}
    allowed = np.array([[[i in _candidates(n, t, first + k, seed) for k in range(first)] for t in range(trees)] for i in range(n)])
    rows, unpack = data.unpacked(["w", "wy"])
    months = boosting._trained(model.months)
    months = {m: found for m, found in months.items() if found}

    def found(batches):
        for month, c, cell in unpack(batches):
            for w in months[month]:
                yield w, c, None, cell

    def one(w, c, _, cell):
        node = [boosting._node(cell.codes, grown.get((w, t), {}), level) - first + t * first for t in range(trees)]
        node, out = np.stack(node) * bins, []
        for i in range(n):
            if (w, i) not in places:
                places[w, i] = np.searchsorted(model.edges[w][i], np.arange(model.codes[i])).astype(np.int32)
            place = (node + places[w, i][cell.codes[i]]).ravel()
            out.append([np.bincount(place, c[x], trees * first * bins) for x in ("wy", "w")])
        return np.array(out).reshape(n, 2, trees, first, bins)

    def cells(part):
        i, tree, node, place = np.nonzero((part[:, 1] > 0) & allowed[..., None])
        return *(x.astype(np.int32) for x in (tree, node + first, i, place)), part[:, 0][i, tree, node, place], part[:, 1][i, tree, node, place]

    return boosting.added(rows.filter(F.col("month_idx").isin(*months)), found, one, cells, "window_id bigint, tree int, node int, feature int, bin int, g double, n double")


def _splits(hist: DataFrame) -> list:
    """window_id, tree, node, the sums g and n, and the best split m (NULL: none), by the variance that it takes away; equal ones go to the first feature and bin."""
    node = ["window_id", "tree", "node"]
    cell = W.partitionBy(*node, "feature")
    upto = cell.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumns({"gl": F.sum("g").over(upto), "nl": F.sum("n").over(upto), "ga": F.sum("g").over(cell), "na": F.sum("n").over(cell)})
    square = lambda g, n: F.try_divide(g * g, n)
    left, right, whole = square(F.col("gl"), F.col("nl")), square(F.col("ga") - F.col("gl"), F.col("na") - F.col("nl")), square(F.col("ga"), F.col("na"))
    gain: Column = F.round((left + right - whole) / F.col("na"), 12)  # sums of doubles differ a little by their order
    best = F.when((F.col("nl") >= 1) & (F.col("na") - F.col("nl") >= 1) & (gain > 0), F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "nl"))
    return hist.groupBy(*node).agg(F.max(best).alias("m"), F.max("ga").alias("g"), F.max("na").alias("n")).collect()  # a row a node


def fit(data: Stored, model: Model, trees: int, depth: int, bins: int, seed: int) -> Forest:
    """Forests of all windows, from rows that were stored with as many bagged trees."""
    grown: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    means: dict[tuple[int, int], dict[int, float]] = {}
    for level in range(depth):
        for r in _splits(_histogram(data, model, grown, level, trees, bins, seed)):
            mean = means.setdefault((r.window_id, r.tree), {})
            mean[r.node] = r.g / r.n
            if r.m is not None:
                grown.setdefault((r.window_id, r.tree), {})[r.node] = (-r.m.f, int(model.edges[r.window_id][-r.m.f][-r.m.b]))
                mean[2 * r.node], mean[2 * r.node + 1] = r.m.gl / r.m.nl, (r.g - r.m.gl) / (r.n - r.m.nl)
    out: dict[int, list[tuple[dict, np.ndarray]]] = {}
    for (w, t), mean in sorted(means.items()):
        values = [next(mean[k >> up] for up in range(depth + 1) if k >> up in mean) for k in range(1 << depth, 2 << depth)]
        out.setdefault(w, []).append((grown.get((w, t), {}), np.array(values)))
    return Forest(out)
