"""Exact top-k search by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

All vectors are written once, ranged by descending length. A batch of queries of bounded size (QUERY_BYTES) goes to all
tasks at a time; each task takes its vectors in blocks of descending length. A query leaves a block where its length
times the block's greatest is below the k-th score it knows; then the sums over the leading rotated components, plus the
product of the lengths of what is left of both (Cauchy-Schwarz), refuse pairs; what remains is scored exactly, in
integers. The rotation (right singular vectors) and the first k-th scores come from a sample of about SAMPLE rows: they decide what
is skipped early, never what is found. A query's partial lists from the tasks are merged by rank.

Every query meets all rows in blocks, so the work grows with queries times rows, less what the bounds skip.
Defined results for nulls, ties, repeated rows, unequal lengths and clashing columns: see `vectors`. Empty tables give
an empty table; fewer than k others give as many as there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .vectors import ROW, Heaps, batches, extent, ids, integers, matrix, numbered

#: Bytes of 64-bit components in a batch of queries: what is broadcast at a time.
QUERY_BYTES = 16 << 20
#: About so many rows give the rotation and the first bounds.
SAMPLE = 4096
#: Queries and vectors of a tile.
TILE = (1024, 2048)
#: Shares of the squared length at which a partial sum is judged.
STAGES = (0.5, 0.8)
#: Above this share of a tile's pairs left by the first bound, the tile is multiplied as a whole.
DENSE = 0.25

FOUND = "query_row long, query_id long, vec_id long, score long"


def _rotation(sample: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Right singular vectors of the sample, greatest first, and the component counts of the stages."""
    if not len(sample):
        return np.eye(sample.shape[1]), []
    _, values, rotation = np.linalg.svd(np.linalg.qr(sample.astype(np.float64), mode="r"))  # the triangular factor has the same right vectors
    energy = np.cumsum(values**2) / max((values**2).sum(), 1.0)
    return rotation.T, sorted({int(np.searchsorted(energy, s)) + 1 for s in STAGES if energy[-1] > 0})


def _rests(rotated: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    """Lengths of what is left of each row after the leading components of each stage."""
    return [np.sqrt((rotated[:, c:] ** 2).sum(1)) for c in counts]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; doubles carry it where no sum can reach 2**53."""
    if np.sqrt((a.astype(float) ** 2).sum(1)).max(initial=0) * np.sqrt((b.astype(float) ** 2).sum(1)).max(initial=0) < 2**52:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class _Queries:
    """A batch of queries, made on the driver and sent to every task."""

    def __init__(self, table: pa.Table, d: int, k: int, sample: np.ndarray, sample_rows: np.ndarray, rotation: np.ndarray, counts: list[int]):
        self.v, self.rows, self.ids = matrix(table["v"], d), np.asarray(table[ROW]), np.asarray(table["id"])
        self.k, self.rotation, self.counts = k, rotation, counts
        self.rotated = self.v @ rotation
        self.norms, self.rests = np.sqrt((self.rotated**2).sum(1)), _rests(self.rotated, counts)
        self.floor = np.full(len(self.v), np.iinfo(np.int64).min)
        for at in range(0, len(self.v) if len(sample) > k else 0, TILE[0]):
            scores = _exact(self.v[at : at + TILE[0]], sample)
            scores[self.rows[at : at + TILE[0], None] == sample_rows] = np.iinfo(np.int64).min
            self.floor[at : at + TILE[0]] = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]

    def block(self, heaps: Heaps, v: np.ndarray, id_: np.ndarray, null: np.ndarray, rows: np.ndarray) -> None:
        rotated = v @ self.rotation
        norms, rests = np.sqrt((rotated**2).sum(1)), _rests(rotated, self.counts)
        longest = norms.max()
        slack = 1 + 1e-9 * self.norms * longest  # above the rounding of the sums
        known = np.maximum(self.floor, heaps.floor)
        open_ = np.flatnonzero(self.norms * longest + slack >= known)
        for at in range(0, len(open_), TILE[0]):
            q = open_[at : at + TILE[0]]
            least = (known[q] - slack[q])[:, None]
            sums, left = np.zeros((len(q), len(v))), np.ones((len(q), len(v)), bool)
            if self.counts:
                c = self.counts[0]
                sums = self.rotated[q, :c] @ rotated[:, :c].T
                left = sums + self.rests[0][q, None] * rests[0] >= least
            if left.mean() > DENSE:
                scores = _exact(self.v[q], v)
                a, b = np.nonzero(scores >= known[q, None])
                score = scores[a, b]
            else:
                a, b = np.nonzero(left)
                partial = sums[a, b]
                for c0, c1, rest_q, rest in zip(self.counts, self.counts[1:], self.rests[1:], rests[1:]):
                    partial += np.einsum("ij,ij->i", self.rotated[q[a], c0:c1], rotated[b, c0:c1])
                    stay = partial + rest_q[q[a]] * rest[b] >= least[a, 0]
                    a, b, partial = a[stay], b[stay], partial[stay]
                score = np.einsum("ij,ij->i", self.v[q[a]], v[b])
            other = self.rows[q[a]] != rows[b]
            a, b, score = a[other], b[other], score[other]
            heaps.add(q[a], score, id_[b], null[b], rows[b])


def _searched(vectors: DataFrame, queries: _Queries, d: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(queries)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        heaps = Heaps(len(q.v), q.k)
        for part in parts:
            for at in range(0, part.num_rows, TILE[1]):
                block = part.slice(at, TILE[1])
                q.block(heaps, matrix(block.column("v"), d), *ids(block.column("id")), np.asarray(block.column(ROW)))
        heap, score, id_, null, _ = heaps.entries
        at = np.flatnonzero(score >= q.floor[heap])
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            columns = [q.rows[heap[i]], q.ids[heap[i]], pa.array(id_[i], mask=null[i].astype(bool)), score[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], ["query_row", "query_id", "vec_id", "score"])

    return vectors.select(ROW, "id", "v").mapInArrow(search, FOUND)


def search(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest of all other rows. is_query: a condition on the column `id`."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), integers(F.col(vector), scale).alias("v")).filter("v is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    order = [F.col("norm").desc(), F.xxhash64("id")]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = numbered(rows.withColumn("norm", norm).repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("id", "v"))
    n, d = extent(vectors)
    queries = vectors.filter(is_query)
    drawn = vectors.filter(F.pmod(F.xxhash64(ROW, F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(n, 1))) + 1).limit(2 * SAMPLE).toArrow()
    sample, sample_rows = matrix(drawn["v"], d), np.asarray(drawn[ROW])
    rotation, counts = _rotation(sample)
    found = None
    for batch in batches(queries, queries.count(), d, query_bytes):
        part = materialize(_searched(vectors, _Queries(batch, d, k, sample, sample_rows, rotation, counts), d))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], FOUND)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
