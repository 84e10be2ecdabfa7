"""What the vector searches share: integer vectors, bounded batches of queries, and matrices from Arrow batches.

Defined results: vectors that are null or hold a null or non-finite component take no part; components become
floor(scale * x), saturated where an inner product could leave 64 bits (documented at `integers`); vectors of unequal
length are filled with zeros to the longest; an empty vector is a vector of zeros; repeated rows are rows of their own;
a null id is never a query, is found like others, and comes last among equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a table are looked up by this number, given when the table was written.
ROW = "row"


def integers(vector: Column, scale: int, bits: int = 31) -> Column:
    """floor(scale * x) for every component; null where the vector takes no part.

    Components saturate at 2**bits / sqrt(length), so that an inner product stays within 2 ** (2 * bits).
    """
    doubles = vector.cast("array<double>")
    fits = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.least(F.floor(F.lit(2.0**bits) / F.sqrt(F.greatest(F.size(vector), F.lit(1)))), F.lit(2**31 - 1)).cast("double")
    return F.when(fits, F.transform(doubles, lambda x: F.least(F.greatest(F.floor(x * scale).cast("double"), -most), most).cast("int")))


def numbered(rows: DataFrame) -> DataFrame:
    """rows as a written table with a number of its own for every row."""
    return materialize(rows.withColumn(ROW, F.monotonically_increasing_id()))


def extent(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and the longest vector of a written table."""
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return n, max(d or 0, 1)


def batches(queries: DataFrame, n: int, d: int, most_bytes: int) -> Iterator[pa.Table]:
    """The queries in batches of about most_bytes of 64-bit components, dealt by the hash of the row number; one at a time is held by the driver."""
    parts = -(-n * d * 8 // most_bytes)
    for part in range(parts):
        yield queries.filter(F.pmod(F.xxhash64(ROW), F.lit(parts)) == part).toArrow()


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """int64 rows of d components, shorter vectors filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = np.asarray(column.offsets, np.int64), np.asarray(column.values, np.int64)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == d).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(at)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values[offsets[0] : offsets[-1]]
    return out


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (null: 0) and which are null."""
    return np.asarray(column.fill_null(0), np.int64), np.asarray(column.is_null())


class Heaps:
    """The k highest (score, then smaller id, null last) entries of each of n heaps, merged from arrays of entries."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, np.iinfo(np.int64).min)  # floor: the k-th score, where there are k
        self.entries = [np.zeros(0, np.int64)] * 5  # heap, score, id, id is null, row

    def add(self, heap: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        worth = score >= self.floor[heap]
        if not worth.any():
            return
        touched = np.zeros(len(self.floor), bool)
        touched[heap[worth]] = True
        old = touched[self.entries[0]]
        new = [np.concatenate([e[old], np.asarray(x)[worth].astype(np.int64)]) for e, x in zip(self.entries, (heap, score, id_, null, row))]
        order = np.lexsort((new[4], new[2], new[3], -new[1], new[0]))
        new = [x[order] for x in new]
        first = np.concatenate(([0], np.flatnonzero(np.diff(new[0])) + 1)) if len(order) else np.zeros(0, np.int64)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        last = place == self.k - 1
        self.floor[new[0][last]] = new[1][last]
        self.entries = [np.concatenate([e[~old], x[place < self.k]]) for e, x in zip(self.entries, new)]
