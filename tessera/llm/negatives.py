"""Hard-negative mining: Strassen products of anchor and candidate tiles, merged into positive and window heaps.

Anchors go out in batches of bounded size (ANCHOR_BYTES); each task takes its rows as they are stored (no row is moved),
a label's rows of an Arrow batch at a time, and multiplies tiles of anchors and rows by Strassen's recursion on 64-bit integers, filled
with zeros to even halves. Sums and differences of 64-bit integers are exact (they wrap, and the result fits), so the
scores are. The first pass meets rows of the anchor's label and keeps a heap of its highest; the heaps of all tasks are
merged by rank. The second meets rows of other labels and keeps a heap for each anchor and positive of the highest
scores in the positive's window. A hot label is dealt over tasks like any other rows.

Every anchor meets all rows in blocks, so the work grows with anchors times rows. Rows with a null label take no part.
Defined results for nulls, ties, repeated rows, unequal lengths and clashing columns: see `vectors`. An empty table, an
anchor without a positive, and a positive without a row in its window give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .vectors import ROW, Heaps, batches, extent, ids, integers, matrix, numbered

#: Bytes of 64-bit components in a batch of anchors: what is broadcast at a time.
ANCHOR_BYTES = 8 << 20
#: Anchors and rows of a tile.
TILE = (1024, 2048)
#: Halving ends where a side of a product is no longer than this.
LEAF = 32


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in integers; doubles carry it where no sum can reach 2**53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of 64-bit integer matrices by seven products of halves; odd sides are filled with a line of zeros."""
    (m, d), n = a.shape, b.shape[1]
    if min(m, d, n) <= leaf:
        return _leaf(a, b)
    if m % 2 or d % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, d % 2))), np.pad(b, ((0, d % 2), (0, n % 2)))
    h, w, v = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :v], b[:w, v:], b[w:, :v], b[w:, v:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * v), np.int64)
    out[:h, :v], out[:h, v:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :v], out[h:, v:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _tiles(part: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """label, vectors, ids, null ids and row numbers, a label of the batch at a time."""
    label, v, (id_, null), row = np.asarray(part.column("label")), matrix(part.column("v"), d), ids(part.column("id")), np.asarray(part.column(ROW))
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(order))):
        for at in range(lo, hi, TILE[1]):
            i = order[at : min(at + TILE[1], hi)]
            yield int(label[i[0]]), v[i], id_[i], null[i], row[i]


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each line; the lowest number where there are fewer."""
    if scores.shape[1] <= k:
        return np.full(len(scores), np.iinfo(np.int64).min + 1)
    return np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, -k], np.iinfo(np.int64).min + 1)


def _add(heaps: Heaps, heap: np.ndarray, scores: np.ndarray, fits: np.ndarray, id_: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
    """The entries that fit, less those below the k-th of their own line."""
    lines = np.flatnonzero(fits.any(1))
    if len(lines):
        open_ = np.where(fits[lines], scores[lines], np.iinfo(np.int64).min)
        a, b = np.nonzero(open_ >= _highest(open_, heaps.k)[:, None])
        heaps.add(heap[lines[a]], open_[a, b], id_[b], null[b], row[b])


def _mined(rows: DataFrame, sent, d: int, k: int, n_heaps: int, step: Callable) -> DataFrame:
    """heap, id, score: the k highest of each of n_heaps heaps, of all tasks. step(heaps, anchors, tile) fills them."""

    def mine(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(n_heaps, k)
        for part in parts:
            for tile in _tiles(part, d):
                step(heaps, sent.value, tile)
        heap, score, id_, null, row = heaps.entries
        for lo in range(0, len(heap), 1 << 16):
            i = slice(lo, lo + (1 << 16))
            columns = [pa.array(heap[i]), pa.array(id_[i], mask=null[i].astype(bool)), pa.array(score[i]), pa.array(row[i])]
            yield pa.RecordBatch.from_arrays(columns, ["heap", "id", "score", ROW])

    found = rows.select(ROW, "id", "label", "v").mapInArrow(mine, "heap long, id long, score long, row long")
    rank = F.row_number().over(W.partitionBy("heap").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), ROW))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _percent(score: np.ndarray, share: int) -> np.ndarray:
    """floor(score * share / 100), without leaving 64 bits."""
    return score // 100 * share + score % 100 * share // 100


def _positive_step(heaps: Heaps, anchors: dict, tile: tuple) -> None:
    label, v, id_, null, row = tile
    mine = np.flatnonzero(anchors["label"] == label)
    for at in range(0, len(mine), TILE[0]):
        q = mine[at : at + TILE[0]]
        scores = strassen(anchors["v"][q], np.ascontiguousarray(v.T))
        _add(heaps, q, scores, (scores >= heaps.floor[q, None]) & (anchors["row"][q, None] != row), id_, null, row)


def _window_step(heaps: Heaps, anchors: dict, tile: tuple) -> None:
    label, v, id_, null, row = tile
    others = np.flatnonzero((anchors["label"] != label) & (anchors["n_heaps"] > 0))
    for at in range(0, len(others), TILE[0]):
        q = others[at : at + TILE[0]]
        scores = strassen(anchors["v"][q], np.ascontiguousarray(v.T))
        for nth in range(int(anchors["n_heaps"][q].max())):
            has = anchors["n_heaps"][q] > nth
            heap = anchors["first_heap"][q[has]] + nth
            least, most = np.maximum(anchors["least"][heap], heaps.floor[heap]), anchors["most"][heap]
            s = scores[has]
            _add(heaps, heap, s, (s >= least[:, None]) & (s <= most[:, None]), id_, null, row)


def mine(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
    id_column: str = "vec_id", vector: str = "embedding", anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on the column `id`; label: an integer expression of df's columns; window: the negative's
    score in per cent of the positive's, both ends included.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), integers(F.col(vector), scale, 29).alias("v"))
    rows = numbered(rows.filter("label is not null and v is not null"))
    _, d = extent(rows)
    anchors = rows.filter(is_anchor)
    out = None
    for table in batches(anchors, anchors.count(), d, anchor_bytes):
        batch = {"v": matrix(table["v"], d), "row": np.asarray(table[ROW]), "label": np.asarray(table["label"]), "id": np.asarray(table["id"])}
        found = _mined(rows, spark.sparkContext.broadcast(batch), d, positives, len(batch["v"]), _positive_step).toArrow().sort_by([("heap", "ascending"), ("rank", "ascending")])
        anchor, score = np.asarray(found["heap"]), np.asarray(found["score"])
        lo, hi = window
        batch |= {"least": -_percent(-score, lo), "most": _percent(score, hi), "n_heaps": np.bincount(anchor, minlength=len(batch["v"]))}
        batch["first_heap"] = np.cumsum(batch["n_heaps"]) - batch["n_heaps"]
        windows = pa.table({"heap": np.arange(len(anchor)), "anchor_id": batch["id"][anchor], "positive_id": found["id"], "positive_score": score})
        second = _mined(rows, spark.sparkContext.broadcast(batch), d, negatives, len(anchor), _window_step)
        part = second.join(spark.createDataFrame(windows), "heap")
        part = materialize(part.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
