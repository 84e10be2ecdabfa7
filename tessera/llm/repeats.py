"""Suffix-array dedup: bytes covered by long strings that also start elsewhere, by run-compressed indexes of candidates.

Every LENGTH-byte string has an anchor, the least hash among its GRAM-byte grams, so equal strings have equal anchors at
equal places. The strings of a text that share an anchor form a context, a stretch of text. Contexts that are equal as
a whole (copies, the inside of shared passages) are settled by an aggregation. The contexts of anchors that are left,
which agree in part, go to the anchor's partition and are indexed together: the suffix array of a batch of contexts,
its Burrows-Wheeler transform compressed into runs with the suffixes sampled at the runs' ends. Longest matches are
computed at the samples only and streamed over the other positions, where each is one less than that of the position
before; suffixes whose neighbours match LENGTH bytes or more are marked.

An anchor with very many distinct contexts is not indexed in one task: its strings are compared by (place, hash) in a
further aggregation, which combines before the shuffle.

Stretches count as equal if 64-bit hashes of the anchor and of the stretch both are; bytes are compared only in the index.

Defined results: null texts are empty; very long texts (up to 2 GB) are one batch of their own; an empty table gives an
empty one; input columns named like a result (in any case) give way to it, others pass; texts under LENGTH bytes lose nothing; exact copies and repeated rows of LENGTH
bytes and more lose everything; matches never cross documents; the order of rows and ties don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, mix64, release, temporary, utf8

LENGTH, GRAM = 400, 32
#: Bytes of contexts indexed together; contexts of one anchor beyond which its strings are aggregated instead.
BATCH, MOST = 1 << 20, 4096
_PLACE = 32  # bits for a position within a chunk, beside the upper bits of the hash
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes; powers of the base and of its inverse up to n."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (_BASE, inverse))
        return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)), up, down


class Hasher:
    """Hashes of any stretch of an array of bytes, or of 64-bit hashes (words)."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(10, int(len(raw)).bit_length())
        value, up, self.down = _powers(size) if size <= 1 << 23 else _powers.__wrapped__(len(raw))
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((value[raw] if raw.dtype == np.uint8 else raw) * up[: len(raw)], dtype=np.uint64)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(np.uint64))


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """For each stretch of windows with one anchor: row, first (window start in the row), off (of the anchor), size, and hashes anchor, ctx."""
    n, width = len(raw), length - gram + 1
    long = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long):
        return {k: np.zeros(0, np.int64) for k in ("row", "first", "off", "size", "anchor", "ctx")}
    hasher = Hasher(raw)
    at = np.arange(n - gram + 1)
    grams = hasher.of(at, at + gram)
    low = ((grams >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | at.astype(np.uint64)
    span = 1
    while 2 * span <= width:  # least of 1, 2, 4, ... grams from each on
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    starts = [np.arange(offsets[r], offsets[r + 1] - length + 1) for r in long]
    row = np.repeat(long, [len(s) for s in starts])
    start = np.concatenate(starts)
    anchor = (low[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(cut[1:], len(start)) - 1
    begin, stop, anchor, row = start[cut], start[last] + length, anchor[cut], row[cut]
    return {"row": row, "first": begin - offsets[row], "off": anchor - begin, "size": stop - begin, "anchor": grams[anchor].view(np.int64), "ctx": hasher.of(begin, stop).view(np.int64)}


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: whether each starts a group of equal ones, and whether its group has others."""
    fresh = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    return fresh, ~(fresh & np.append(fresh[1:], True)[: len(key)])


class RunIndex:
    """Suffix array of a batch, its run-compressed Burrows-Wheeler transform, suffixes sampled at run ends."""

    def __init__(self, symbols: np.ndarray):
        """symbols: 1 to 256, and 0 after each text."""
        n, self.symbols = len(symbols), symbols
        present = np.bincount(symbols, minlength=1) > 0
        dense = (np.cumsum(present) - present[0])[symbols]
        self.width = 62 // max(1, int(present.sum()).bit_length())  # symbols in one word
        packed, bits = np.zeros(n, np.int64), 62 // self.width
        for k in range(self.width):
            packed = (packed << bits) | np.append(dense[k:], np.zeros(min(k, n), np.int64))[:n]
        order = np.argsort(packed)
        fresh, tied = _starts(packed[order])
        slot, size = np.flatnonzero(tied), self.width
        rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # the first place of those that agree so far
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.levels = [(size, rank)]
        while len(slot):  # only those that still agree with another are sorted on
            at = order[slot]
            after = np.where(at + size < n, rank[np.minimum(at + size, n - 1)], -1)
            key = rank[at].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key)
            order[slot] = at = at[by]
            fresh, tied = _starts(key[by])
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(fresh, slot, 0))
            slot, size = slot[tied], 2 * size
            self.levels.append((size, rank))
        self.n, self.sa, self.rank = n, order, rank
        bwt = symbols[order - 1]  # the symbol before the first suffix is the last, cyclically
        fresh = np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)))  # starts of texts are sampled each
        self.run_starts = np.flatnonzero(fresh[:n])
        self.run_symbols = bwt[self.run_starts]
        self.sampled = order[self.run_starts]  # first suffix of each run; the run before ends at the suffix above
        self.above = np.where(self.run_starts > 0, order[self.run_starts - 1], -1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes a and b, by descent through the ranks of doubling lengths."""
        total, a, b = np.zeros(len(a), np.int64), a.copy(), b.copy()
        for size, rank in reversed(self.levels):
            fits = (a + size <= self.n) & (b + size <= self.n)
            same = fits.copy()
            same[fits] = rank[a[fits]] == rank[b[fits]]
            total[same] += size
            a[same] += size
            b[same] += size
        for _ in range(self.width - 1):  # what is shorter than the first level, by its symbols
            fits = (a < self.n) & (b < self.n)
            same = fits.copy()
            same[fits] = self.symbols[a[fits]] == self.symbols[b[fits]]
            total[same] += 1
            a, b = np.where(same, a + 1, self.n), np.where(same, b + 1, self.n)
        return total

    def matches(self) -> np.ndarray:
        """For each position, the longest match with the suffix above it in the suffix array.

        Where the transform's run goes on, position p's suffix and the one above are preceded by one symbol, so the
        match at p is that at p - 1 less one: only the samples at run ends are compared.
        """
        known = np.full(self.n, -1, np.int64)
        has = self.above >= 0
        known[self.sampled] = 0
        known[self.sampled[has]] = self.common(self.sampled[has], self.above[has])
        at = np.maximum.accumulate(np.where(known >= 0, np.arange(self.n), 0))
        return np.maximum(known[at] - (np.arange(self.n) - at), 0)


def marked(texts: list[bytes], owner: np.ndarray, first: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, the window starts in it that occur at another place (owner, position) of the batch."""
    sizes = np.array([len(x) for x in texts])
    symbols = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    ends = np.cumsum(sizes + 1)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    symbols[np.arange(len(raw)) + text_of] = raw.astype(np.int64) + 1
    index = RunIndex(symbols)
    match = index.matches()
    # Neighbours in the suffix array that match long enough are one class; a class at two places is a repeat.
    new = match[index.sa] < length
    new[:1] = True
    group = np.cumsum(new) - 1
    text_at = np.repeat(np.arange(len(texts)), sizes + 1)
    begin = ends - sizes - 1
    inside = np.arange(len(symbols)) - begin[text_at]
    valid = (inside + length <= sizes[text_at])[index.sa]
    sa, group = index.sa[valid], group[valid]
    if not len(sa):
        return [np.zeros(0, np.int64) for _ in texts]
    place = owner[text_at[sa]] * (1 << 40) + first[text_at[sa]] + inside[sa]
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    differ = np.minimum.reduceat(place, head) != np.maximum.reduceat(place, head)
    hit = np.sort(sa[np.repeat(differ, np.diff(np.append(head, len(sa))))])
    cut = np.searchsorted(hit, np.append(begin, len(symbols)))
    return [hit[cut[i] : cut[i + 1]] - begin[i] for i in range(len(texts))]


def runs(starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Covered stretches (start, stop) of sorted window starts."""
    cut = np.flatnonzero(np.concatenate(([True], np.diff(starts) > length))) if len(starts) else np.zeros(0, np.int64)
    return starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + length if len(starts) else starts


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("tid"), text.alias("text"))


_KEYS = ["anchor", "off", "size", "ctx"]


def find(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, spans): for each text with repeats, the digest and the stretches (start, stop) that windows found elsewhere cover."""
    with temporary(docs.sparkSession):  # contexts and shuffle files go before the texts are read for cutting
        return materialize(_found(docs, length), stay=True)


def _found(docs: DataFrame, length: int) -> DataFrame:
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = _digested(docs)

    def cut_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 21):
            c = contexts(*utf8(batch.column("text")), length)
            row = pa.array(c["row"])
            arrays = [pa.array(c["anchor"]), pa.array(c["off"].astype(np.int32)), pa.array(c["size"].astype(np.int32)), pa.array(c["ctx"]), batch.column("tid").take(row), batch.column("doc_id").take(row), pa.array(c["first"].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*_KEYS, "tid", "doc_id", "first"])

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "tid", "first", "bytes")}
            for tid, text, parts in zip(batch.column("tid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("parts").to_pylist(), strict=True):
                for p in parts:
                    out["anchor"].append(p["anchor"])
                    out["tid"].append(tid)
                    out["first"].append(p["first"])
                    out["bytes"].append(text[p["first"] : p["first"] + p["size"]])
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["tid"], pa.binary()), pa.array(out["first"], pa.int32()), pa.array(out["bytes"], pa.binary())], names=list(out))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, anchor = 0, None
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "tid", "first", "bytes")), strict=True):
                if x[0] != anchor and size >= BATCH:
                    yield settle(held)
                    held, size = [], 0
                anchor = x[0]
                held.append(x)
                size += len(x[3])
        if held:
            yield settle(held)

    def settle(held: list[tuple]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        owner = np.array([number.setdefault(x[1], len(number)) for x in held])
        first = np.array([x[2] for x in held])
        tids, begin, stop = [], [], []
        for x, hit in zip(held, marked([x[3] for x in held], owner, first, length), strict=True):
            a, b = runs(hit, length)
            tids += [x[1]] * len(a)
            begin += (a + x[2]).tolist()
            stop += (b + x[2]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32())], names=["tid", "start", "stop"])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of hot contexts: the anchor, a hash of the window, its place."""
        for batch in batches:
            raw, offsets = utf8(batch.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
            hasher, count = Hasher(raw), np.maximum(np.diff(offsets) - length + 1, 0)
            row = np.repeat(np.arange(batch.num_rows), count)
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[row] + inside
            first = batch.column("first").to_numpy()[row] + inside
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(take), pa.array(hasher.of(at, at + length).view(np.int64)), batch.column("tid").take(take), pa.array(first.astype(np.int32))], names=["anchor", "h", "tid", "start"])

    spark = docs.sparkSession
    rows = materialize(docs.mapInArrow(cut_contexts, "anchor bigint, off int, size int, ctx bigint, tid binary, doc_id bigint, first int"))
    same = materialize(rows.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.min(F.struct("tid", "first")).alias("one")))
    release(spark)
    equal = rows.join(same.filter("n > 1").select(*_KEYS), _KEYS, "left_semi").select("tid", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"))

    groups = same.groupBy("anchor").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("single")).filter("k > 1 and single > 0").select("anchor", "k")
    left = same.join(groups, "anchor").select(F.col("one.tid").alias("tid"), F.struct("anchor", F.col("one.first").alias("first"), "size").alias("part"), "k")
    by_text = left.groupBy("tid").agg(F.collect_list("part").alias("parts"))
    reps = rows.groupBy("tid").agg(F.min("doc_id").alias("rep"))
    by_text = by_text.join(reps, "tid").withColumnRenamed("tid", "_tid")
    texts = docs.join(by_text, (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("tid", "text", "parts")
    parts = materialize(texts.mapInArrow(fetch, "anchor bigint, tid binary, first int, bytes binary"))
    hot = materialize(groups.filter(F.col("k") > MOST).select("anchor"))  # few: each stands for over MOST contexts
    release(spark)
    is_hot = bool(hot.take(1))
    cold = parts.join(hot, "anchor", "left_anti") if is_hot else parts
    indexed = cold.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(index, "tid binary, start int, stop int")
    spans = equal.unionByName(indexed)
    if is_hot:
        every = materialize(parts.join(hot, "anchor", "left_semi").mapInArrow(windows, "anchor bigint, h bigint, tid binary, start int"))
        release(spark)
        twice = every.groupBy("anchor", "h").agg(F.min(F.struct("tid", "start")).alias("a"), F.max(F.struct("tid", "start")).alias("b")).filter("a != b").select("anchor", "h")
        spans = spans.unionByName(every.join(twice, ["anchor", "h"], "left_semi").select("tid", "start", (F.col("start") + length).alias("stop")))
    return spans.groupBy("tid").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def remove(docs: DataFrame, length: int = LENGTH, columns: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The given columns of docs (all if None, without text; none named like a result) with n_bytes, spans (maximal removed stretches) and kept (the remaining bytes; as_text: without characters that a cut has left in part)."""
    spans = find(docs, length).withColumnRenamed("tid", "_tid")
    columns = [c for c in docs.columns if c != "text"] if columns is None else columns
    kept = [f for f in docs.schema.fields if f.name in columns and f.name.lower() not in ("n_bytes", "spans", "kept")]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tid"))
    rows = rows.join(spans, F.col("tid") == F.col("_tid"), "left").select(*schema.names[:-3], "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            found, rest, sizes = [], [], []
            for raw, spans_of in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                merged: list[dict] = []
                for s in spans_of or ():
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(dict(s))
                at, pieces = 0, []
                for s in merged:
                    pieces.append(raw[at : s["start"]])
                    at = s["stop"]
                left = b"".join([*pieces, raw[at:]])
                rest.append(left.decode("utf-8", "ignore") if as_text else left)
                found.append(merged)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-3]), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(rest, pa.string() if as_text else pa.binary())], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], "n_bytes", "spans", "kept")
