"""Near-duplicate classes by Order MinHash, with candidates verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number. For each of SKETCHES hash
functions the ORDER least shingles are sampled and kept in text order; their combination is a sketch. Texts that share a
sketch are candidates: as the order counts, sketches agree as edit similarity does. A link is kept if aligning the two
shingle sequences within the band that the threshold allows gives matches / (n_a + n_b - matches) >= THRESHOLD. Exact
copies are one node from the start. Classes are the connected components of the links.

A sketch's holders are compared to its first and to its last holder. Where that leaves holders in several components,
a second key decides: of the shingles of all these holders, ordered by how often they occur (in a table of COUNTERS
hashed counters) and then by hash, two texts that align to the threshold share one among their first
n - ceil(threshold * n) + 1, so only holders that share such a shingle are compared. This loses no pair, and a passage
that very many texts have counts as frequent and makes no candidates. Rounds of pivots go over these groups until any
two holders of one are in one component or have been compared (shingles are equal if their 64-bit hashes are); pairs that can't align by their sizes, by the places of
the shared shingle or by the parities of their shingle counts aren't made.

Defined results: null texts count as empty; texts without words are equal only to their exact copies; texts of one to
four words have one shingle; the class id is the least doc_id of the class; repeated rows are in the same class and
each is returned; a class without any doc_id has a null id; other columns, whatever their names, are ignored by `classes`
and kept by `distinct`; an empty table gives an empty one; very long texts are aligned in a band of bits, not pair by pair
of words; ties of sketches and pivots are settled by hash, and the classes don't depend on the order of rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, mix64, temporary, utf8

SHINGLE, ORDER, SKETCHES, THRESHOLD = 5, 3, 12, 0.8
PIVOTS, BINS = 2, 128
#: Unmatched items up to which furthest reaching points are followed; counters of how often shingles occur.
FEW, COUNTERS = 6, 1 << 20
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 rows and the rows' offsets among them: differences of prefix sums of byte values times powers, brought back to power 0."""
    n = len(raw)
    blank = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    word = ~blank
    starts = np.flatnonzero(word & (begins[:n] | np.concatenate(([True], blank[:-1])))) if n else np.zeros(0, np.int64)
    stops = np.flatnonzero(word & (begins[1:] | np.concatenate((blank[1:], [True])))) + 1 if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        value = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[raw] * power[:n], dtype=np.uint64)))
        hashes = mix64((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles in order, and the rows' offsets; a row of fewer words has one shingle, one without words none."""
    n_words = np.diff(offsets)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(out[-1]) - out[row] + offsets[row]
    stop = offsets[row + 1]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            here = at + k < stop
            h = mix64(h + np.where(here, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))) if len(words) else h
    return h, out


def labelled(shingles: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shingles scrambled with the number of equal ones before them in their row."""
    n = len(shingles)
    with np.errstate(over="ignore"):
        tag = mix64(shingles ^ mix64(row.astype(np.uint64)))  # equal within a row only
        by = np.argsort(tag, kind="stable")
        same = np.concatenate(([False], tag[by][1:] == tag[by][:-1]))
        run = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        occurrence = np.empty(n, np.uint64)
        occurrence[by] = (np.arange(n) - run).astype(np.uint64)
        return mix64(shingles + occurrence * _STEP)


def sketches(shingles: np.ndarray, offsets: np.ndarray, order: int = ORDER, count: int = SKETCHES) -> np.ndarray:
    """(rows, count) sketches of rows that have a shingle each."""
    n, row = len(shingles), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    tagged = labelled(shingles, row)
    with np.errstate(over="ignore"):
        out = np.zeros((len(offsets) - 1, count), np.uint64)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        for k in range(count):
            v = mix64(tagged ^ mix64(np.uint64([k + 1]) * _BASE))
            places = np.full((len(offsets) - 1, order), n, np.int64)
            for j in range(order):
                at = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, offsets[:-1]), np.diff(offsets)))
                first = np.concatenate(([True], row[at][1:] != row[at][:-1]))
                at = at[first]
                taken = v[at] != top  # rows with fewer shingles run out
                places[row[at[taken]], j] = at[taken]
                v[at] = top
            places.sort(axis=1)
            h = np.zeros(len(offsets) - 1, np.uint64)
            for j in range(order):
                h = mix64(h * _BASE + np.append(shingles, np.uint64(j))[places[:, j]])
            out[:, k] = mix64(h + np.uint64(k))
    return out


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """matches / (n_a + n_b - matches) of the best alignment of two sequences if that is threshold or more, else 0.

    Only diagonals within the number of unmatched items that the threshold allows are visited: furthest reaching points
    while these are few, then a band of bits. Common ends are cut beforehand, and texts whose contents can't suffice
    are refused at once.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    least = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))  # matches needed
    if min(n, m) < least:
        return 0.0
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < least:
        return 0.0
    short = min(n, m)
    differs = a[:short] != b[:short]
    head = int(differs.argmax()) if differs.any() else short
    differs = (a[n - short :] != b[m - short :])[::-1][: short - head]
    tail = int(differs.argmax()) if differs.any() else short - head
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    allowed = n + m - 2 * least
    apart = _distance(x, y, min(allowed, FEW))
    if apart is None and allowed > FEW:
        apart = _banded(x, y, allowed)
    if apart is None:
        return 0.0
    matches = (n + m - apart) // 2
    return matches / (n + m - matches)


def _distance(x: list, y: list, most: int) -> int | None:
    """Insertions and deletions between two lists if `most` at most: the furthest point on each diagonal for 0, 1, 2, ... of them."""
    n, m = len(x), len(y)
    if not n or not m:
        return n + m if n + m <= most else None
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            reach[k] = i
            if i >= n and j >= m:
                return d
    return None


def _banded(x: list, y: list, most: int, block: int = 2048) -> int | None:
    """The same for many of them, by the bits of a band: bit i of `open_` is 0 where x[i] lengthens the best common subsequence.

    A path with `most` unmatched items at most leaves the main diagonal by no more than `most`, so a block of rows needs
    the bits from its first row - most to its last + most; bits before are final, bits after aren't reached yet.
    """
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return None
    places: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        places.setdefault(v, []).append(i)
    least = (n + m - most + 1) // 2
    low, high, open_, matches = 0, 0, 0, 0
    for top in range(0, m, block):
        bottom = min(m, top + block)
        left, right = min(n, max(0, top - most)), min(n, bottom + most + 1)
        cut = left - low
        if cut > 0:
            settled = open_ & ((1 << cut) - 1)
            matches += min(cut, high - low) - settled.bit_count()
            open_ >>= cut
            low = left
            high = max(high, low)
        if right > high:
            open_ |= ((1 << (right - high)) - 1) << (high - low)
            high = right
        width = high - low
        mask = (1 << width) - 1
        for v in y[top:bottom]:
            found = places.get(v)
            if found is None:
                continue
            if len(found) <= 4:
                hit = 0
                for i in found:
                    if low <= i < high:
                        hit |= 1 << (i - low)
            else:
                inside = np.array(found[bisect_left(found, low) : bisect_left(found, high)], np.int64) - low
                bits = np.zeros(width, np.uint8)
                bits[inside] = 1
                hit = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if hit:
                step = open_ & hit
                open_ = ((open_ + step) | (open_ - step)) & mask
        if matches + width - open_.bit_count() + m - bottom < least:
            return None
    matches += high - low - open_.bit_count()
    apart = n + m - 2 * matches
    return apart if apart <= most else None


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, tid (digest of the text) and sketches of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 21):
            shingles, at = shingle_hashes(*word_hashes(*utf8(batch.column("text"))))
            some = np.flatnonzero(np.diff(at))
            found = sketches(shingles, np.append(at[some], at[-1])) if len(some) else np.zeros((0, SKETCHES), np.uint64)
            ends = np.zeros(batch.num_rows + 1, np.int32)
            ends[some + 1] = SKETCHES
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(found.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), lists], names=["doc_id", "tid", "sketches"])

    return _digested(docs).mapInArrow(run, "doc_id bigint, tid binary, sketches array<bigint>")


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("tid"), text.alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts align."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(chunks(batches, "text_a"), "text_b"):
            (sa, at), (sb, bt) = (shingle_hashes(*word_hashes(*utf8(batch.column(c)))) for c in ("text_a", "text_b"))
            keep = [alignment(sa[at[i] : at[i + 1]], sb[bt[i] : bt[i + 1]], threshold) >= threshold for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _profiled(texts: DataFrame) -> DataFrame:
    """tid, number of shingles and their counts in BINS bins of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 21):
            shingles, at = shingle_hashes(*word_hashes(*utf8(batch.column("text"))))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            counts = np.bincount(row * BINS + (shingles % np.uint64(BINS)).astype(np.int64), minlength=batch.num_rows * BINS)
            profile = np.minimum(counts, 65535).astype(np.uint16).tobytes()
            size = 2 * BINS
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(np.diff(at), pa.int64()), pa.array([profile[i * size : (i + 1) * size] for i in range(batch.num_rows)], pa.binary())], names=["tid", "n", "profile"])

    return texts.mapInArrow(run, "tid binary, n bigint, profile binary")


def _possible(pairs: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose profiles don't differ by more than the unmatched items that the threshold allows; no pair that aligns is lost."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32) for c in ("profile_a", "profile_b"))
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            allowed = total - 2 * np.ceil(threshold * total / (1 + threshold) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(np.abs(a - b).sum(axis=1) <= allowed))

    for side in "ab":
        pairs = pairs.join(profiles.select(F.col("tid").alias(side), F.col("n").alias(f"n_{side}"), F.col("profile").alias(f"profile_{side}")), side)
    return pairs.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b): every node of an edge and the least node of its component.

    Each round links the larger neighbours of every node to its least neighbour, then the node itself and its smaller
    neighbours to the least of them, until the edges are stars. Least neighbours come from partial aggregation and a
    join, so a node with very many edges is no single task.
    """
    edges = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Stars: no node is at once a lower and an upper end, or has two upper ends.
        ends = edges.select("u", F.lit(1).alias("low")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("low")))
        if ends.groupBy("u").agg(F.sum("low").alias("n"), F.min("low").alias("least")).filter("n > 1 or n = 1 and least = 0").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """label, (node, root), after the links found: only the roots they join are worked on."""
    for side in "ab":
        found = found.join(label.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    ends = found.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = materialize(components(ends)).withColumnRenamed("root", "to")
    moved = label.join(joined, F.col("root") == joined["node"], "left").select(label["node"], F.coalesce("to", "root").alias("root"))
    return moved.unionByName(joined.join(label.select("node"), "node", "left_anti").select("node", F.col("to").alias("root")))


def _pairs(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _counts(texts: DataFrame) -> np.ndarray:
    """COUNTERS hashed counts of the labelled shingles of all texts: an array of fixed size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in chunks(batches, "text", 1 << 21):
            shingles, at = shingle_hashes(*word_hashes(*utf8(batch.column("text"))))
            tagged = labelled(shingles, np.repeat(np.arange(batch.num_rows), np.diff(at)))
            total += np.bincount((tagged % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int32)
    out[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 31) - 1)
    return out


def _rarest(texts: DataFrame, threshold: float) -> DataFrame:
    """Each text's first n - ceil(threshold * n) + 1 shingles by rising count, then by hash: tid, key, left (shingles from it on), n (all), and the parities of the text's counts in 256 bins."""
    counts = texts.sparkSession.sparkContext.broadcast(_counts(texts))  # COUNTERS numbers, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 21):
            shingles, at = shingle_hashes(*word_hashes(*utf8(batch.column("text"))))
            n = np.diff(at)
            row = np.repeat(np.arange(batch.num_rows), n)
            tagged = labelled(shingles, row)
            odd = np.bincount(row * 256 + (shingles >> np.uint64(56)).astype(np.int64), minlength=256 * batch.num_rows) & 1
            odd = np.packbits(odd.astype(np.uint8).reshape(-1, 256), axis=1).view(np.int64)
            order = np.lexsort((tagged, counts.value[(tagged % np.uint64(COUNTERS)).astype(np.int64)], row))
            first = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            place = np.arange(len(order)) - at[row]  # rows stay in their places
            keep = place < first[row]
            row, key = row[keep], tagged[order[keep]].view(np.int64)
            numbers = [key, (n[row] - place[keep]).astype(np.int32), n[row].astype(np.int32), *(odd[row, k] for k in range(4))]
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(row)), *map(pa.array, numbers)], names=["tid", "key", *_SIZES])

    return texts.select("tid", "text").mapInArrow(run, "tid binary, key bigint, left int, n int, p0 bigint, p1 bigint, p2 bigint, p3 bigint")


_SIZES = ("left", "n", "p0", "p1", "p2", "p3")


def _may_align(threshold: float) -> Column:
    """Whether a holder and a pivot can have the matches needed, if the key is the first shingle they share (some key is)."""
    both = F.col("n") + F.col("pivot_n")
    least = F.ceil(threshold * both / (1 + threshold) - 1e-9)
    odd = F.lit(0)
    for k in range(4):
        odd = odd + F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"pivot_p{k}")))
    return (F.least("left", "pivot_left") >= least) & (odd <= both - 2 * least)


def _apart(holders: DataFrame, label: DataFrame, key: list[str]) -> DataFrame:
    """The holders (key, tid and more) with their roots, of the keys whose holders are in several components."""
    rooted = holders.drop("root").join(label.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    parted = rooted.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select(key)
    return rooted.join(parted, key)


def _completed(rest: DataFrame, pairs: DataFrame, links: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the components of all links among texts that share a sketch, given the pairs compared so far, the links found, and the holders (band, sketch, tid) not yet compared to all others of their sketch.

    A round takes up to `most` pivots of each key whose holders are in several components, the ones with most links
    first, and compares them to all holders of other components; then they are settled. Each round has 16 times as
    many, so that rounds stay few.
    """
    label = materialize(components(links))
    wanted = materialize(_apart(rest, label, ["band", "sketch"]).select("tid").distinct())
    if wanted.isEmpty():
        return label
    texts = materialize(texts.join(wanted, "tid").select("tid", "text"))
    held = materialize(_rarest(texts, threshold))
    shared = held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    held, most, profiles = held.join(shared, "key"), PIVOTS, None
    while True:
        held = materialize(_apart(held, label, ["key"]))
        if held.isEmpty():
            return label
        if profiles is None:
            profiles = materialize(_profiled(texts.join(held.select("tid").distinct(), "tid").select("tid", "text")))
        degree = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("degree"))
        mixed = F.xxhash64("tid", F.lit(most))
        ranked = held.join(degree, "tid", "left").select("key", F.pmod(mixed, F.lit(most)).alias("slot"), F.struct((-F.coalesce("degree", F.lit(0))).alias("degree"), mixed.alias("mixed"), "tid", "root", *_SIZES).alias("rank"))
        named = [F.col(f"rank.{c}").alias(f"pivot_{c}") for c in ("tid", "root", *_SIZES)]
        pivots = materialize(ranked.groupBy("key", "slot").agg(F.min("rank").alias("rank")).select("key", *named))
        new = held.join(pivots, "key").filter((F.col("root") != F.col("pivot_root")) & _may_align(threshold)).select(_pairs("tid", "pivot_tid")).distinct()
        new = materialize(_possible(new.join(pairs, ["a", "b"], "left_anti"), profiles, threshold))
        found = materialize(_verified(new, texts, threshold))
        pairs, links = pairs.unionByName(new), links.unionByName(found)
        if not found.isEmpty():
            label = materialize(_merged(label, found))
        held = held.join(pivots.select("key", F.col("pivot_tid").alias("tid")), ["key", "tid"], "left_anti")
        most *= 16


def _labelled(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, tid and class_id of every row of docs, as a table; those it was made from are removed."""
    with temporary(docs.sparkSession):
        return materialize(_classified(docs, threshold), stay=True)


def _classified(docs: DataFrame, threshold: float) -> DataFrame:
    rows = materialize(_sketched(docs))
    nodes = rows.groupBy("tid").agg(F.min("doc_id").alias("rep"), F.first("sketches").alias("sketches"))
    holders = materialize(nodes.select("tid", "rep", F.posexplode("sketches").alias("band", "sketch")))
    groups = holders.groupBy("band", "sketch").agg(F.min("tid").alias("low"), F.max("tid").alias("high"), F.count("*").alias("n")).filter("low != high")
    near = holders.join(groups, ["band", "sketch"])
    ends = F.explode(F.array("low", "high"))
    pairs = materialize(near.select(F.col("tid").alias("a"), ends.alias("b")).filter("a != b").select(_pairs("a", "b")).distinct())
    wanted = pairs.select(F.col("a").alias("tid")).unionByName(pairs.select(F.col("b").alias("tid"))).distinct()
    wanted = wanted.join(holders.select("tid", "rep").distinct(), "tid")
    texts = _digested(docs).join(wanted.withColumnRenamed("tid", "_tid"), (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("tid", "text")
    texts = materialize(texts)
    rest = near.filter("n > 3 and tid != low and tid != high")  # these two are compared to all others
    label = _completed(rest, pairs, materialize(_verified(pairs, texts, threshold)), texts, threshold)
    label = nodes.select("tid", "rep").join(label, F.col("tid") == F.col("node"), "left").select("tid", "rep", F.coalesce("root", "tid").alias("root"))
    ids = label.groupBy("root").agg(F.min("rep").alias("class_id"))
    label = label.join(ids, "root").select("tid", "class_id")
    return rows.select("doc_id", "tid").join(label, "tid")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every row of (doc_id, text)."""
    return _labelled(docs.select("doc_id", "text"), threshold).select("doc_id", "class_id")


def distinct(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the one with the least id; its columns as they are."""
    columns = docs.columns
    inner = docs.select(F.col("doc_id").alias("_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_tid"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("_row"))
    chosen = _labelled(docs.select("doc_id", "text"), threshold).filter("doc_id <=> class_id")
    chosen = chosen.groupBy("class_id").agg(F.min("tid").alias("tid"), F.count("*").alias("n"))
    kept = inner.join(chosen, (F.col("_tid") == F.col("tid")) & F.col("_id").eqNullSafe(F.col("class_id")))
    once = kept.filter("n = 1").unionByName(kept.filter("n > 1").dropDuplicates(["_id", "_tid"]))
    return once.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(columns)])
