"""Boosted trees on absolute error for all rolling windows at once, with a learning rate that decays in steps.

Rows are stored once, whatever number of windows they are in: keys, label, for each feature the number of the windows'
bin edges below its value, and for each stage a bit a window that says whether the row is drawn. They lie by month and
by features, so that rows with the same ones follow each other: trees are walked once for such a run (a cell), and
what is left for a row and window is a comparison. A stage fits one tree a window to the signs of the residuals, which
every pass works out anew from the trees so far, so rows are never copied into windows or written again. A level of all
trees is one pass: tasks count signs by window, node, feature and bin, Spark adds these counts up; they are whole
numbers, so they don't depend on how rows are dealt and reruns give the same trees. A leaf's value is the median residual of its rows, exactly,
by histograms of narrower ranges and then the values of the one cell. The driver holds edges, splits and leaves alone.

Missing features count as 0; rows without a label are scored but not fitted; a window without labelled training rows
scores NULL.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import avg_rank
from tessera.streaming.feeds import written

#: Cells of a leaf's histogram, the rows of a cell below which its values are listed, and the histograms at most (values are listed after these in any case).
CELLS, FEW, NARROWED = 512, 1 << 16, 4
#: Shares of a month that are dealt apart when rows are stored, at least; rows of a share on average, at most; rows that a pass takes at a time.
SHARES, SHARE, BLOCK = 2, 500_000, 1 << 16
#: Stages whose draws are stored with the rows (a pass works out those of later ones), and windows to a column of bits.
STAGES, BITS = 16, 63


@dataclass(frozen=True)
class Settings:
    """rows and columns: shares drawn for each tree; least: rows of a child; alpha, ridge: penalties; gain: least worth of a split; patience: stages without a better validation error."""

    rounds: int = 10
    depth: int = 3
    rate: float = 0.2
    decay_every: int = 4
    decay: float = 0.8
    rate_floor: float = 0.1
    patience: int = 3
    rows: float = 0.8
    columns: float = 0.5
    least: int = 20
    alpha: float = 0.1
    ridge: float = 1.0
    gain: float = 0.01
    bins: int = 32
    seed: int = 1

    def rate_at(self, stage: int) -> float:
        """The rate falls by the factor at every decay_every-th stage, to rate_floor of the first at the least."""
        return max(self.rate * self.decay ** (stage // self.decay_every), self.rate * self.rate_floor)


@dataclass
class Model:
    """What tasks get: the windows of each month, places of a window's edges among all edges, first scores, trees as (splits, steps of the leaves), the best stage."""

    months: dict[int, list[tuple[int, str]]]
    codes: list[int] = field(default_factory=list)  # of each feature
    edges: dict[int, list[np.ndarray]] = field(default_factory=dict)
    base: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[tuple[dict, np.ndarray]]] = field(default_factory=dict)
    best: dict[int, int] = field(default_factory=dict)

    def fresh(self) -> Model:
        """The same table's model before any fit."""
        return replace(self, base={}, trees={}, best={})

    def score(self, window: int, codes: list[np.ndarray], upto: int | None = None) -> np.ndarray:
        f = np.full(len(codes[0]), self.base[window])
        for splits, steps in self.trees.get(window, [])[:upto]:
            f += _node(codes, splits, len(steps).bit_length() - 1, steps)
        return f

    def final(self, window: int, codes: list[np.ndarray]) -> np.ndarray | None:
        """Scores by the best stage; None for a window without training rows."""
        return self.score(window, codes, self.best.get(window, 0)) if window in self.base else None


@lru_cache(4096)
def _table(asked: tuple[int, ...], levels: int) -> np.ndarray:
    """The leaf, from 0, for every set of answers (bits) to the splits of these nodes; where a node isn't split rows go left."""
    out = []
    for x in range(1 << len(asked)):
        node = 1
        for _ in range(levels):
            node = 2 * node + (x >> asked.index(node) & 1 if node in asked else 0)
        out.append(node - (1 << levels))
    return np.array(out, np.int32)


def _node(codes: list[np.ndarray], splits: dict, levels: int, steps: np.ndarray | None = None) -> np.ndarray:
    """The node of every row, `levels` below the root, or the step of its leaf: the answers to all splits are bits of a number, which a table takes to the node."""
    first, asked = 1 << levels, tuple(k for k in sorted(splits) if k < 1 << levels)
    if len(asked) > 12:  # deep trees: level by level
        node = np.ones(len(codes[0]), np.int32)
        for level in range(levels):
            step = np.zeros(len(node), np.int32)
            for k in (k for k in asked if k >> level == 1):
                at = np.flatnonzero(node == k)
                step[at] = codes[splits[k][0]][at] > splits[k][1]
            node = 2 * node + step
        return node if steps is None else steps[node - first]
    bits = np.zeros(len(codes[0]), np.uint8 if len(asked) <= 8 else np.uint16)
    for i, k in enumerate(asked):
        bits |= (codes[splits[k][0]] > splits[k][1]).view(np.uint8).astype(bits.dtype, copy=False) << bits.dtype.type(i)
    table = _table(asked, levels)
    return (table + first if steps is None else steps[table])[bits]


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mixed(values: np.ndarray) -> tuple[np.ndarray, int]:
    """What xxhash64 makes of integers before the seed comes in, and their bytes: 4 for int32, else 8."""
    if values.dtype == np.int32:
        return values.view(np.uint32).astype(np.uint64) * _P[0], 4
    return _turned(values.view(np.uint64) * _P[1], 31) * _P[0], 8


def _hashed(mixed: tuple[np.ndarray, int], seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of integers, chained by the seed."""
    h, size = (seed + (_P[4] + np.uint64(mixed[1]))) ^ mixed[0], mixed[1]
    h = _turned(h, 23 if size == 4 else 27)
    h *= _P[1] if size == 4 else _P[0]
    h += _P[2] if size == 4 else _P[3]
    for shift, by in ((33, _P[1]), (29, _P[2]), (32, None)):
        h ^= h >> np.uint64(shift)
        if by is not None:
            h *= by
    return h


def _keyed(window: int, keys: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """xxhash64(window, keys), which all stages share."""
    h = _hashed(_mixed(np.array([window], np.int64)), np.array([42], np.uint64))
    for k in keys:
        h = _hashed(k, h)
    return h


def _shared(h: np.ndarray, stage: int, s: Settings) -> np.ndarray:
    for k in (_mixed(np.array([stage], np.int32)), _mixed(np.array([s.seed], np.int32))):
        h = _hashed(k, h)
    return h.view(np.int64) % 10_000 < int(s.rows * 10_000)


def _drawn(window: int, keys: list[tuple[np.ndarray, int]], stage: int, s: Settings) -> np.ndarray:
    """Whether a row is drawn for a window's tree: pmod(xxhash64(window, keys, stage, seed), 10000) under the share."""
    return _shared(_keyed(window, keys), stage, s)


class Cells(NamedTuple):
    """Rows that follow each other and have the same codes: where each cell begins, its number of rows, its codes."""

    starts: np.ndarray
    lengths: np.ndarray
    codes: list[np.ndarray]

    def spread(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x, self.lengths)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, dtype=np.int64 if x.dtype == bool else x.dtype)


def _cells(columns: dict[str, np.ndarray], edges: list[np.ndarray]) -> Cells:
    """The cells of rows that are sorted by their features."""
    x = [columns[f"x{i}"] for i in range(len(edges))]
    new = np.zeros(len(columns["month_idx"]), bool)
    new[:1] = True
    for v in x:
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return Cells(starts, np.diff(starts, append=len(new)), [np.searchsorted(e, v[starts]).astype(np.int32) for e, v in zip(edges, x)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, dict[str, np.ndarray]]]:
    """month, rows that follow each other in one month, some BLOCK at most, and their columns."""

    def blocks():
        some, n = [], 0
        for b in batches:
            some.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield some
                some, n = [], 0
        if n:
            yield some

    for some in blocks():
        t = pa.Table.from_batches(some).combine_chunks()
        columns = {f.name: t[f.name].to_numpy() for f in t.schema if pa.types.is_primitive(f.type)}
        month = columns["month_idx"]
        cuts = [0, *(np.flatnonzero(np.diff(month)) + 1).tolist(), len(month)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield int(month[i]), t.slice(i, j - i), {c: v[i:j] for c, v in columns.items()}


def _trained(months: dict[int, list[tuple[int, str]]]) -> dict[int, list[int]]:
    """The windows that train on each month, in the order of their bits."""
    return {m: sorted(w for w, k in found if k == "train") for m, found in months.items()}


@dataclass
class Stored:
    """The rows of all windows, once, and the labelled ones packed for passes; a pass gives each task's counts or rows.

    packed: a row for some rows of a month, with the bytes of their columns: a value takes a microsecond to get to Python
    alone and next to nothing so. stages: those whose draws are stored; edges: all windows' bin edges of each feature.
    """

    rows: DataFrame
    packed: DataFrame
    keys: list[str]
    edges: list[np.ndarray]
    stages: int
    base: tuple | None = None  # bounds of labels and the windows' first scores, which all settings share

    def unpacked(self, names: list[str]) -> tuple[DataFrame, Callable]:
        """The packed columns that a pass reads; month, these columns and cells, pack by pack."""
        n, types = len(self.edges), dict(self.rows.dtypes)
        kinds = {c: np.int32 if types.get(c) == "int" else np.float64 if types.get(c) == "double" or c in ("w", "wy") else np.int64 for c in names}

        def found(batches):
            for b in batches:
                for i in range(b.num_rows):
                    held = lambda c, kind: np.frombuffer(b[c][i].as_buffer(), kind)  # noqa: B023, E731
                    lengths = held("lengths", np.int32)
                    yield b["month_idx"][i].as_py(), {c: held(c, kinds[c]) for c in names}, Cells(np.cumsum(lengths) - lengths, lengths, [held(f"c{j}", np.int32) for j in range(n)])

        return self.packed.select("month_idx", "lengths", *[f"c{j}" for j in range(n)], *names), found

    def _labelled(self, split: str, model: Model, active: set[int], stage: int | None) -> tuple[DataFrame, Callable]:
        """The columns that a pass reads; window, marks (see drawn), labels and cells of the labelled rows of that split of the active windows, pack by pack."""
        months = {m: [w for w, k in found if k == split and w in active] for m, found in model.months.items()}
        months, slots = {m: found for m, found in months.items() if found}, _trained(model.months)
        words = -(-max(map(len, slots.values()), default=0) // BITS)
        kept, hashed = stage is not None and stage < self.stages, stage is not None and stage >= self.stages
        hashes = [f"k{i}" for i in range(len(self.keys))]
        rows, unpack = self.unpacked(["y", *([f"d{stage}_{i}" for i in range(words)] if kept else hashes if hashed else [])])

        def found(batches):
            for month, c, cell in unpack(batches):
                keys = [_mixed(c[k]) for k in hashes] if hashed else None
                for w in months[month]:
                    at = slots[month].index(w) if kept else 0
                    yield w, keys if hashed else [(c[f"d{stage}_{at // BITS}"] if kept else c["y"], at % BITS)], c["y"], cell

        return rows.filter(F.col("month_idx").isin(*months)), found

    def drawn(self, stage: int, s: Settings) -> Callable:
        """Whether rows are drawn for a window's tree, from a pass's marks: stored bits and the window's place among them, or keys."""
        if stage < self.stages:
            return lambda w, marks: marks[0][0] & np.int64(1 << marks[0][1]) != 0
        return lambda w, marks: _drawn(w, marks, stage, s)

    def summed(self, one: Callable, cells: Callable, columns: str, split: str, model: Model, active: set[int], stage: int | None = None) -> DataFrame:
        """The arrays that `one(window, marks, y, cells)` gives, added up by window in each task; `cells` names those that aren't 0 (its last two columns are sums), and Spark adds up the tasks'."""
        return added(*self._labelled(split, model, active, stage), one, cells, columns)

    def listed(self, one: Callable, split: str, model: Model, active: set[int], stage: int | None = None) -> DataFrame:
        """window_id, node, value, n: how often each of the values that `one` lists comes; equal ones are counted within a task first."""
        rows, found = self._labelled(split, model, active, stage)

        def task(batches):
            for some in batched(found(batches), 256):
                parts = [(w, *one(w, k, y, cell)) for w, k, y, cell in some]
                t = pa.table({"window_id": np.concatenate([np.full(len(v), w, np.int64) for w, _, v in parts]), "node": np.concatenate([x for _, x, _ in parts]).astype(np.int64), "value": np.concatenate([v for _, _, v in parts]) + 0.0})
                yield from t.group_by(["window_id", "node", "value"]).aggregate([([], "count_all")]).select(["window_id", "node", "value", "count_all"]).rename_columns(["window_id", "node", "value", "n"]).to_batches()

        return rows.mapInArrow(task, "window_id bigint, node bigint, value double, n bigint").groupBy("window_id", "node", "value").agg(F.sum("n").alias("n"))


def added(rows: DataFrame, found: Callable, one: Callable, cells: Callable, columns: str) -> DataFrame:
    """See `summed`; `found` gives what `one` takes from a task's batches."""
    names = [c.split()[0] for c in columns.split(", ")]

    def task(batches):
        sums: dict[int, np.ndarray] = {}
        for w, k, y, cell in found(batches):
            part = one(w, k, y, cell)
            if w in sums:
                sums[w] += part
            else:
                sums[w] = part
        for w, part in sums.items():
            out = cells(part)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(out[0]), w, np.int64), *out)], names=names)

    return rows.mapInArrow(task, columns).groupBy(*names[:-2]).agg(*[F.sum(c).alias(c) for c in names[-2:]])


#: Below these a Poisson variable of mean 1 is 0, 1, ... at most.
POISSON = np.cumsum([1 / math.factorial(i) for i in range(18)]) / math.e


def _bagged(mixed: list[tuple[np.ndarray, int]], tree: int, seed: int) -> np.ndarray:
    """How often the rows of these keys are in a tree's bootstrap sample: a Poisson variable of mean 1, by their hash."""
    h = np.array([42], np.uint64)
    for k in (*mixed, _mixed(np.array([tree], np.int32)), _mixed(np.array([seed], np.int32))):
        h = _hashed(k, h)
    return np.searchsorted(POISSON, (h >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def stored(df: DataFrame, windows: DataFrame, features: list[str], label: str, s: Settings, keys: list[str], ranked: bool = False, bagged: int = 0) -> tuple[Stored, Model]:
    """Rows by month and cell with their places among the edges and their draws; edges are quantiles of each window's own training rows, from the counts of each month's values.

    ranked: with r, the rank of the label among its month's less the mean rank; bagged: with w and wy, the sums of weights
    and of weights times labels of each cell in the bootstrap samples of so many trees.
    """
    spark, types = df.sparkSession, dict(df.dtypes)
    months: dict[int, list[tuple[int, str]]] = {}
    for r in windows.select("month_idx", F.col("window_id").cast("bigint"), "split").collect():  # windows times months
        months.setdefault(r[0], []).append((r[1], r[2]))
    whole = lambda c: F.col(c).cast("int") if types[c] in ("tinyint", "smallint") else F.col(c) if types[c] in ("int", "bigint") else F.xxhash64(c)
    raw = written(df.select(*keys, *[whole(c).alias(f"k{i}") for i, c in enumerate(keys)], *([] if "month_idx" in keys else ["month_idx"]), F.col(label).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]))
    model, n = Model(months), len(features)
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"x{i}").alias("x")) for i in range(n)]))
    cells = raw.filter("y is not null").groupBy("month_idx", *[f"x{i}" for i in range(n)]).agg(F.count("*").alias("n"))
    counts = cells.select("month_idx", "n", values.alias("v")).groupBy("month_idx", "v.feature", "v.x").agg(F.sum("n").alias("n"))
    train = F.broadcast(spark.createDataFrame([(w, m) for m, found in months.items() for w, k in found if k == "train"], f"window_id bigint, month_idx {types['month_idx']}"))  # windows times months
    probs = [i / s.bins for i in range(1, s.bins)]
    edges = counts.join(train, "month_idx").groupBy("window_id", "feature").agg(F.array_distinct(F.percentile("x", probs, F.col("n"))).alias("e")).collect()
    every = [np.unique(np.array([e for r in edges if r.feature == i for e in r.e], np.float64)) for i in range(n)]
    model.codes = [len(e) + 1 for e in every]
    for r in edges:
        model.edges.setdefault(r.window_id, [np.zeros(0, np.int64)] * n)[r.feature] = np.searchsorted(every[r.feature], np.unique(np.array(r.e, np.float64)))
    if ranked:
        month = W.partitionBy("month_idx")
        raw = raw.repartition("month_idx").withColumn("r", avg_rank("y", "month_idx") - (F.count("y").over(month) + 1) / 2)
    total = raw.count()
    shares = max(SHARES, -(-total // (SHARE * max(1, len(months)))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))
    rows = written(raw.repartition(parts, "month_idx", F.pmod(F.xxhash64(*keys), F.lit(shares))).sortWithinPartitions("month_idx", *[f"x{i}" for i in range(n)]))

    trained, stages = _trained(months), min(s.rounds, STAGES)
    words = -(-max(map(len, trained.values()), default=0) // BITS)
    bits = [f"d{stage}_{i}" for stage in range(stages) for i in range(words)]
    hashes = [f"k{i}" for i in range(len(keys))]
    held = ["y", *(["r"] if ranked else []), *(hashes if s.rounds > stages else [])]  # later stages are drawn by the keys
    names = ["lengths", *[f"c{i}" for i in range(n)], *held, *bits, *(["w", "wy"] if bagged else [])]

    def pack(batches):
        for month, _, c in _runs(batches):
            cell, mixed, marks = _cells(c, every), [_mixed(c[k]) for k in hashes], np.zeros((stages, words, len(c["y"])), np.int64)
            for at, w in enumerate(trained.get(month, [])):
                h = _keyed(w, mixed)
                for stage in range(stages):
                    marks[stage, at // BITS] |= _shared(h, stage, s).astype(np.int64) << np.int64(at % BITS)
            columns = [cell.lengths.astype(np.int32), *cell.codes, *[c[k] for k in held], *marks.reshape(-1, len(c["y"]))]
            if bagged:
                weights = [_bagged(mixed, tree, s.seed) for tree in range(bagged)]
                columns += [np.concatenate([cell.sums(x) for x in weights]), np.concatenate([cell.sums(x * c["y"]) for x in weights])]
            yield pa.RecordBatch.from_arrays([pa.array([month], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["month_idx", *names])

    packed = rows.filter("y is not null and not isnan(y)").select(*dict.fromkeys(["month_idx", *hashes, *held, *[f"x{i}" for i in range(n)]])).mapInArrow(pack, ", ".join(["month_idx bigint", *[f"{c} binary" for c in names]])).persist()
    return Stored(rows, packed, keys, every, stages), model


def _worth(g: Column, n: Column, s: Settings) -> Column:
    return F.pow(F.greatest(F.abs(g) - s.alpha, F.lit(0.0)), 2) / (n + s.ridge)


def _splits(hist: DataFrame, s: Settings) -> list[tuple[int, int, int, int, float]]:
    """The best split of each window and node: (window, node, feature, bin, gain); equal gains go to the first feature and bin."""
    cell = W.partitionBy("window_id", "node", "feature")
    upto = cell.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumns({"gl": F.sum("g").over(upto), "nl": F.sum("n").over(upto), "ga": F.sum("g").over(cell), "na": F.sum("n").over(cell)})
    gain = _worth(F.col("gl"), F.col("nl"), s) + _worth(F.col("ga") - F.col("gl"), F.col("na") - F.col("nl"), s) - _worth(F.col("ga"), F.col("na"), s)
    hist = hist.withColumn("gain", F.round(gain, 9)).filter((F.col("nl") >= s.least) & (F.col("na") - F.col("nl") >= s.least) & (F.col("gain") > s.gain))
    best = hist.groupBy("window_id", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("m"))
    return [(r.window_id, r.node, -r.m.f, -r.m.b, r.m.gain) for r in best.collect()]  # a row a node


def _histogram(data: Stored, model: Model, active: set[int], grown: dict, level: int, columns: list[int], stage: int, s: Settings) -> DataFrame:
    """Sums of signs and counts of the drawn training rows by window, node, feature and bin."""
    first, bins, places, drawn = 1 << level, s.bins, {}, data.drawn(stage, s)

    def one(w, marks, y, cell):
        at, f = drawn(w, marks), cell.spread(model.score(w, cell.codes))
        n, g = cell.sums(at), cell.sums((y > f) & at) - cell.sums((y < f) & at)
        node, out = (_node(cell.codes, grown.get(w, {}), level) - first) * bins, []
        for i in columns:
            if (w, i) not in places:
                places[w, i] = np.searchsorted(model.edges[w][i], np.arange(model.codes[i])).astype(np.int32)
            place = node + places[w, i][cell.codes[i]]
            out.append([np.bincount(place, x, first * bins) for x in (g, n)])
        return np.array(out).astype(np.int64).reshape(len(columns), 2, first, bins)

    def cells(part):
        i, node, place = np.nonzero(part[:, 1])
        return node + first, np.array(columns, np.int32)[i], place.astype(np.int32), part[:, 0][i, node, place], part[:, 1][i, node, place]

    return data.summed(one, cells, "window_id bigint, node bigint, feature int, bin int, g bigint, n bigint", "train", model, active, stage)


def _medians(data: Stored, model: Model, active: set[int], grown: dict, depth: int, drawn: Callable, span: dict[int, tuple[float, float]], stage: int | None = None) -> dict[tuple[int, int], float]:
    """The median residual of the drawn training rows of each (window, node), exactly; span: bounds of a window's residuals."""
    first = 1 << depth
    # windows' histograms so far, each as rows by leaf: lowest value, width of a cell, first and last cell kept
    ranges = {w: [np.tile([span[w][0], (span[w][1] - span[w][0]) / CELLS, 0, CELLS - 1], (first, 1))] for w in active}

    def residuals(w, marks, y, rows):
        """Leaf, residual and cell in the newest histogram of the drawn rows that the ones before kept."""
        at = np.flatnonzero(drawn(w, marks))
        res = y[at] - (rows.spread(model.score(w, rows.codes))[at] if w in model.base else 0.0)
        leaf = rows.spread(_node(rows.codes, grown.get(w, {}), depth) - first)[at]
        for i, chain in enumerate(ranges[w]):
            if i:
                kept = np.flatnonzero((cell >= last[2][leaf]) & (cell <= last[3][leaf]))
                res, leaf = res[kept], leaf[kept]
            last = np.ascontiguousarray(chain.T)
            low, width = (last[0][leaf], last[1][leaf]) if i else last[:2, 0]  # the first histogram has one range
            with np.errstate(divide="ignore", invalid="ignore"):
                cell = np.nan_to_num((res - low) / width).clip(0, CELLS - 1).astype(np.int32)
        return leaf, res, cell

    def histogram(w, marks, y, rows):
        leaf, _, cell = residuals(w, marks, y, rows)
        return np.bincount(leaf * CELLS + cell, minlength=first * CELLS)

    def cells(part):
        at = np.flatnonzero(part)
        return at // CELLS + first, at % CELLS, part[at], part[at]

    def middle(w, marks, y, rows):
        leaf, res, cell = residuals(w, marks, y, rows)
        last = ranges[w][-1].T
        kept = (cell >= last[2][leaf]) & (cell <= last[3][leaf])
        return leaf[kept] + first, res[kept]

    def at_middle(counts: DataFrame, by: str, before: dict | None) -> list:
        """The cells or values that hold the two middle rows of each window and node; before: rows under what is counted, and all rows."""
        node = W.partitionBy("window_id", "node")
        rows = counts.withColumns({"upto": F.sum("n").over(node.orderBy(by)), "all": F.sum("n").over(node)})
        if before is not None:
            table = counts.sparkSession.createDataFrame([(w, k, b, a) for (w, k), (b, a) in before.items()], "window_id bigint, node bigint, under bigint, total bigint")
            rows = rows.join(F.broadcast(table), ["window_id", "node"]).withColumn("upto", F.col("upto") + F.col("under")).withColumn("all", F.col("total"))  # windows times leaves
        holds = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
        return rows.filter(holds(F.floor((F.col("all") - 1) / 2)) | holds(F.floor(F.col("all") / 2))).select("window_id", "node", by, "n", "upto", "all").collect()

    under: dict[tuple[int, int], tuple[int, int]] | None = None
    for turn in range(NARROWED):
        found = at_middle(data.summed(histogram, cells, "window_id bigint, node bigint, cell bigint, n bigint, same bigint", "train", model, active, stage), "cell", under)
        under, most = {}, 0
        for r in found:
            lower, total = under.get((r.window_id, r.node), (r.upto, r.all))
            under[r.window_id, r.node] = min(lower, r.upto - r.n), total
            most = max(most, r.n)
        for w, chains in ranges.items():
            for leaf in range(first):
                mine = [r.cell for r in found if (r.window_id, r.node) == (w, leaf + first)]
                if mine:
                    chains[-1][leaf, 2:] = min(mine), max(mine)
        if most <= FEW or turn == NARROWED - 1:
            break
        for w, chains in ranges.items():
            low, width, i, j = chains[-1].T
            chains.append(np.stack([low + i * width, (j + 1 - i) * width / CELLS, np.zeros(first), np.full(first, CELLS - 1)], axis=1))
    out: dict[tuple[int, int], list[float]] = {}
    for r in at_middle(data.listed(middle, "train", model, active, stage), "value", under) if under else []:
        out.setdefault((r.window_id, r.node), []).append(r.value)
    return {key: v[0] if len(v) == 1 else 0.5 * min(v) + 0.5 * max(v) for key, v in out.items()}


def _scores(data: Stored, model: Model, split: str, scorers: dict[str, Callable] | None = None) -> DataFrame:
    """The rows of a split of all windows with the scores that each scorer (of window and codes; None: NULL) gives, by default those of the best stage."""
    months = {m: [w for w, k in found if k == split] for m, found in model.months.items()}
    months, keys, edges = {m: found for m, found in months.items() if found}, data.keys, data.edges
    scorers = scorers or {"score": model.final}

    def task(batches):
        for month, rows, c in _runs(batches):
            cell = _cells(c, edges)
            for w in months[month]:
                found = [one(w, cell.codes) for one in scorers.values()]
                found = [pa.nulls(rows.num_rows, pa.float64()) if x is None else pa.array(cell.spread(x)) for x in found]
                yield from pa.table([pa.array(np.full(rows.num_rows, w, np.int64)), *[rows[k] for k in (*keys, "y")], *found], names=["window_id", *keys, "y", *scorers]).to_batches()

    types = {f.name: f.dataType.simpleString() for f in data.rows.schema.fields}
    rows = data.rows.filter(F.col("month_idx").isin(*months)).select(*dict.fromkeys([*keys, "month_idx"]), "y", *[f"x{i}" for i in range(len(edges))])
    out = rows.mapInArrow(task, ", ".join(["window_id bigint", *[f"`{c}` {types[c]}" for c in keys], "y double", *[f"{c} double" for c in scorers]]))
    return out.select("window_id", F.lit(split).alias("split"), *keys, "y", *scorers)


def fit_windows(df: DataFrame, windows: DataFrame, features: list[str], label: str = "label_rank", settings: Settings | None = None, keys: tuple[str, ...] = ("entity", "month_idx"), given: tuple[Stored, Model] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, importances and histories of all windows (window_id, month_idx, split).

    Scores: window_id, split, keys, y, score for validation and test rows, by the stage with the least validation error;
    importances: window_id, feature, gain up to that stage; histories: window_id, stage, rate, error (stage 0: the median).
    given: these rows as stored for such settings (rows, bins and seed) before, and the model that is to be fitted.
    """
    s, spark, keys = settings or Settings(), df.sparkSession, list(keys)
    data, model = given or stored(df, windows, features, label, s, keys)
    if data.base is None:
        low, high = data.rows.agg(F.min("y"), F.max("y")).first()
        every = {w for found in model.months.values() for w, _ in found}
        anyone = lambda w, k: np.ones(len(k[0][0]), bool)
        data.base = low, high, {w: v for (w, _), v in _medians(data, model, every, {}, 0, anyone, dict.fromkeys(every, (low, high))).items()} if low is not None else {}
    low, high, model.base = data.base
    reach = {w: (f, f) for w, f in model.base.items()}  # least and greatest score of a window

    def errors_of(active: set[int]) -> dict[int, float]:
        one = lambda w, marks, y, cell: np.array([np.abs(y - cell.spread(model.score(w, cell.codes))).sum(), len(y)])
        return {r.window_id: r.e / r.n for r in data.summed(one, lambda part: (part[:1], part[1:]), "window_id bigint, e double, n double", "valid", model, active).collect()}

    least, best_stage = errors_of(set(model.base)), model.best
    history = [(w, 0, 0.0, e) for w, e in least.items()]
    gains: list[tuple[int, int, int, float]] = []
    for stage in range(s.rounds):
        active = {w for w in least if stage - best_stage.get(w, 0) < s.patience}
        if not active:
            break
        columns = sorted(random.Random(s.seed * 1_000_003 + stage).sample(range(len(features)), max(1, round(s.columns * len(features)))))
        grown: dict[int, dict[int, tuple[int, int]]] = {}
        for level in range(s.depth):
            found = _splits(_histogram(data, model, active, grown, level, columns, stage, s), s)
            gains += [(w, stage + 1, f, gain) for w, _, f, _, gain in found]
            for w, node, f, at, _ in found:
                grown.setdefault(w, {})[node] = (f, int(model.edges[w][f][at]))
        span = {w: (low - reach[w][1], high - reach[w][0]) for w in active}
        leaves = _medians(data, model, active, grown, s.depth, data.drawn(stage, s), span, stage)
        for w in active:
            steps = np.array([s.rate_at(stage) * leaves.get((w, (1 << s.depth) + i), 0.0) for i in range(1 << s.depth)])
            model.trees.setdefault(w, []).append((grown.get(w, {}), steps))
            reach[w] = (reach[w][0] + steps.min(), reach[w][1] + steps.max())
        errors = errors_of(active)
        history += [(w, stage + 1, s.rate_at(stage), e) for w, e in errors.items()]
        better = [w for w, e in errors.items() if e < least[w] - 1e-12]  # sums of doubles differ that much by their order
        least |= {w: errors[w] for w in better}
        best_stage.update(dict.fromkeys(better, stage + 1))
    if given is None:
        data.packed.unpersist()
    sums: dict[tuple[int, str], float] = {(w, f): 0.0 for w in least for f in features}
    for w, stage, f, gain in gains:
        if stage <= best_stage.get(w, 0):
            sums[w, features[f]] += gain
    scores = _scores(data, model, "valid").unionByName(_scores(data, model, "test"))  # a filter on split leaves one
    importances = spark.createDataFrame([(w, f, g) for (w, f), g in sums.items()], "window_id bigint, feature string, gain double")
    return scores, importances, spark.createDataFrame(history, "window_id bigint, stage int, rate double, error double")


def judge(data: Stored, model: Model) -> DataFrame:
    """window_id, error, ic of the validation rows (stored with r): mean absolute error, and the mean over months of the rank correlation.

    Scores are few, one a set of leaves: tasks add up ranks and errors by window, month and score, and ranks of scores come from their counts.
    """
    months = {m: [w for w, k in found if k == "valid" and w in model.base] for m, found in model.months.items()}
    months = {m: found for m, found in months.items() if found}
    rows, unpack = data.unpacked(["y", "r"])

    def task(batches):
        for month, c, cell in unpack(batches):
            b, bb = cell.sums(c["r"]), cell.sums(c["r"] ** 2)
            for w in months[month]:
                f = model.final(w, cell.codes)
                score, at = np.unique(f, return_inverse=True)
                sums = [np.bincount(at, x, len(score)) for x in (cell.lengths, b, bb, cell.sums(np.abs(c["y"] - cell.spread(f))))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(score), w, np.int64), np.full(len(score), month, np.int64), score, *sums)], names=["window_id", "month_idx", "score", "n", "b", "bb", "e"])

    rows = rows.filter(F.col("month_idx").isin(*months)).mapInArrow(task, "window_id bigint, month_idx bigint, score double, n double, b double, bb double, e double")
    rows = rows.groupBy("window_id", "month_idx", "score").agg(*[F.sum(c).alias(c) for c in ("n", "b", "bb", "e")])
    month = W.partitionBy("window_id", "month_idx")
    rows = rows.withColumn("a", F.sum("n").over(month.orderBy("score")) - F.col("n") / 2 - F.sum("n").over(month) / 2)  # mean rank of the score's rows, less that of all
    cross = F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("n") * F.col("a") ** 2)) * F.sqrt(F.sum("bb")))
    found = rows.groupBy("window_id", "month_idx").agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.coalesce(cross, F.lit(0.0)).alias("ic"))
    return found.groupBy("window_id").agg((F.sum("e") / F.sum("n")).alias("error"), F.avg("ic").alias("ic"))


def run_trials(df: DataFrame, windows: DataFrame, features: list[str], grid: list[Settings], results: str, label: str = "label_rank") -> DataFrame:
    """number, window_id, error, ic for every candidate of the grid and every window; `results` is the table of what is done.

    Each candidate's rows are appended as it ends, as a partition of their own; one that is there already, from a run
    that was cut off, isn't run again. The number is the candidate's place in the grid. Rows are stored once for all
    candidates that share bins and draws.
    """
    spark = df.sparkSession
    schema = "window_id bigint, error double, ic double, number int"

    def done() -> set[int]:
        try:
            return {r.number for r in spark.read.schema(schema).parquet(results).select("number").distinct().collect()}
        except Exception as error:  # no table yet
            if "PATH_NOT_FOUND" in str(error):
                return set()
            raise

    there, keys, kept = done(), ("entity", "month_idx"), {}
    alike = lambda s: (s.bins, s.rows, s.seed)
    for number, settings in enumerate(grid):
        if number not in there:
            if alike(settings) not in kept:
                most = max(s.rounds for i, s in enumerate(grid) if i not in there and alike(s) == alike(settings))
                kept[alike(settings)] = stored(df, windows, features, label, replace(settings, rounds=most), list(keys), ranked=True)
            data, model = kept[alike(settings)]
            model = model.fresh()
            fit_windows(df, windows, features, label, settings, keys, (data, model))
            part = judge(data, model).withColumn("number", F.lit(number))
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("number").parquet(results)
    for data, _ in kept.values():
        data.packed.unpersist()
    return spark.read.schema(schema).parquet(results).select("number", "window_id", "error", "ic")
