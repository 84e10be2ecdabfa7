"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding; and token counts without ids.

Pre-tokenisation is a finite automaton over classes of code points. Each code point is a function on the automaton's
states; functions compose associatively, so the states before all code points come from a blocked prefix scan over
composed functions (table look-ups on arrays), and a token starts where state and class say so. No regular expression
is run. A document boundary is a constant function, so a whole batch of texts is scanned at once.

Defined results: null and empty texts have no tokens; rows are encoded alone, so ties and repeated rows don't matter;
very long texts and very long pre-tokens work (merging uses a heap); an empty table gives an empty one; other columns
pass through, but columns of the results' names (ids, token_ends, decoded) are replaced; `count_tokens` ignores others.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, utf8
from .frequencies import Frequencies, unpack

# Classes of code points, and of those that depend on what follows.
OTHER, LETTER, NUMBER, SPACE, BLANK, JOINING, ALONE, SHORT, LONG, END = range(10)
# JOINING: a space before a token, part of it; ALONE: another blank there; SHORT, LONG: an apostrophe that may start
# a contraction of one or two letters; END: between texts.
# States: what the last code point belongs to.
FRESH, IN_BLANK, JOINED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_MORE, TWO_MORE = range(8)
_N_STATES, _N_SYMBOLS = 8, 10
#: Pre-tokens that a worker remembers at once.
CACHE = 200_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]: whether a token starts at this code point."""
    after = np.zeros((_N_SYMBOLS, _N_STATES), np.uint8)
    starts = np.ones((_N_SYMBOLS, _N_STATES), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        after[symbol] = run
        starts[symbol, [run, JOINED]] = False
    for symbol in (SPACE, BLANK):
        after[symbol] = IN_BLANK
        starts[symbol, IN_BLANK] = False
    after[JOINING], after[ALONE], after[END] = JOINED, FRESH, FRESH
    for symbol, wait in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        after[symbol] = wait
        for state in (IN_OTHERS, JOINED):  # inside a run of others, or after its space
            after[symbol, state], starts[symbol, state] = IN_OTHERS, False
    after[LETTER, ONE_MORE], after[LETTER, TWO_MORE] = FRESH, ONE_MORE
    starts[LETTER, [ONE_MORE, TWO_MORE]] = False
    return after, starts


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that compositions of symbols give: id of each symbol, composition table (first * n + second), values, starts."""
    after, starts = _automaton()
    known: dict[tuple, int] = {}
    values: list[tuple] = []

    def number(f: tuple) -> int:
        if f not in known:
            known[f] = len(values)
            values.append(f)
        return known[f]

    symbols = [number(tuple(int(x) for x in after[s])) for s in range(_N_SYMBOLS)]
    done = 0
    while done < len(values):
        f = values[done]
        for s in range(_N_SYMBOLS):
            number(tuple(int(after[s][x]) for x in f))
        done += 1
    table = [[known[tuple(g[x] for x in f)] for g in values] for f in values]
    return np.array(symbols, np.uint16), np.array(table, np.uint16).ravel(), np.array(values, np.uint8), starts


@cache
def _classes() -> np.ndarray:
    """The class of every code point, from the Unicode categories; blanks are the White_Space property."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = BLANK
    table[0x20] = SPACE
    return table


def _scan(symbols: np.ndarray, block: int = 128) -> np.ndarray:
    """The state before each symbol."""
    ids, table, values, _ = _monoid()
    n, m = len(symbols), len(values)
    rows = -(-n // block)
    f = np.full(rows * block, ids[END], np.uint16)
    f[:n] = ids[symbols]
    f = np.ascontiguousarray(f.reshape(rows, block).T)
    upto = np.empty_like(f)  # upto[j]: the composition of a block's first j + 1 functions
    upto[0] = f[0]
    for j in range(1, block):
        np.take(table, upto[j - 1].astype(np.int32) * m + f[j], out=upto[j], mode="clip")
    carry, step = upto[-1].copy(), 1  # inclusive scan over blocks by doubling
    while step < rows:
        carry[step:] = table[carry[:-step].astype(np.int32) * m + carry[step:]]
        step *= 2
    enter = np.full(rows, FRESH, np.uint8)
    enter[1:] = values[carry[:-1], FRESH]
    state = np.empty((block, rows), np.uint8)
    state[0] = enter
    flat, enter = values.ravel(), enter.astype(np.int32)
    for j in range(1, block):
        state[j] = flat[upto[j - 1].astype(np.int32) * _N_STATES + enter]
    return state.T.ravel()[:n]


def pre_tokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of the texts in order, and how many each text has."""
    if not texts:
        return [], np.zeros(0, np.int64)
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols = _classes()[points]
    symbols[ends] = END
    following = np.append(symbols[1:], np.uint8(END))
    blank = (symbols == SPACE) | (symbols == BLANK)
    last = blank & (following < SPACE)  # before a code point that is no blank, in the same text
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.append(points, [0, 0])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        symbols[quote[one]], symbols[quote[two]] = SHORT, LONG
    symbols[last & (symbols == SPACE)] = JOINING
    symbols[last & (symbols == BLANK)] = ALONE
    state = _scan(symbols)
    _, _, _, starts = _monoid()
    at = np.flatnonzero(starts.ravel()[symbols.astype(np.int32) * _N_STATES + state])
    real = symbols[at[:-1]] != END
    begin, stop = at[:-1][real], at[1:][real]
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    return [joined[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], counts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 60
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of (rank, place) over a linked list, for pre-tokens of any length."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left, j = parts[i], after[i]
        if left is None or j >= n or len(left) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = left + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(both := parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(both)))
    return [ranks[p] for p in parts if p is not None]


class PairTable:
    """The rank that any two adjacent tokens merge to, by binary search; merges many pre-tokens at once, a pair of each in a step."""

    NONE = 1 << 40

    def __init__(self, ranks: dict[bytes, int]):
        keys, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], -1)
        self.merged = np.append(np.array(merged, np.int64)[order], self.NONE)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a << 20 | b, -2)
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.merged[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after the other, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max()) + 1
        inside = np.arange(width) < sizes[:, None]
        out = np.full((len(pieces), width), -1, np.int64)
        out[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rows, ids = np.arange(len(pieces)), out.copy()
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        column = np.arange(width)
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            done = best == self.NONE
            if done.any():
                out[rows[done]] = ids[done]
                rows, ids, rank, at, best = (x[~done] for x in (rows, ids, rank, at, best))
                if not len(rows):
                    break
            r = np.arange(len(rows))
            ids[r, at] = best
            later = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, later, 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(later[:, :-1], width - 2), 1)
            rank[:, -1] = self.NONE
            rank[r, at] = self.rank(best, ids[r, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], best[left])
        used = out >= 0
        return out[used], used.sum(1)


class Encoder:
    """Ids of pre-tokens, remembered per worker; flat arrays with offsets, so that texts are assembled without loops."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.size = 0
        self.flat, self.offsets = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The place of each pre-token in the cache; new ones are merged."""
        if len(self.index) > CACHE:
            self.reset()
        index = self.index
        fresh = [p for p in dict.fromkeys(pieces) if p not in index]
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for low, high in ((0, 8), (8, 16), (16, 48)):  # of like size, as shorter ones are padded
            some = np.flatnonzero((sizes > low) & (sizes <= high)).tolist()
            for k in range(0, len(some), 1 << 15):
                part = some[k : k + (1 << 15)]
                self._keep([fresh[i] for i in part], *self.pairs.merge([raw[i] for i in part]))
        for i in np.flatnonzero(sizes > 48).tolist():
            ids = merge(raw[i], self.ranks)
            self._keep([fresh[i]], np.array(ids), np.array([len(ids)]))
        return np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, at = len(self.index), self.size
        self.size = at + len(ids)
        if self.size > len(self.flat):
            self.flat = np.resize(self.flat, 2 * self.size)
        if first + len(pieces) >= len(self.offsets):
            self.offsets = np.resize(self.offsets, 2 * (first + len(pieces)))
        self.flat[at : self.size] = ids
        self.offsets[first + 1 : first + len(pieces) + 1] = at + np.cumsum(sizes)
        self.index.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts among them."""
        pieces, counts = pre_tokens(texts)
        numbers = self.numbers(pieces)
        begin, lengths = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        return gather(self.flat, begin, lengths), row_offsets(lengths, counts)

    def lengths(self, pieces: list[str]) -> np.ndarray:
        numbers = self.numbers(pieces)
        return self.offsets[numbers + 1] - self.offsets[numbers]


def gather(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[begin : begin + length], one after the other."""
    out_at = np.cumsum(lengths) - lengths
    return flat[np.repeat(begin - out_at, lengths) + np.arange(int(lengths.sum()))]


def row_offsets(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Offsets of rows that have counts[i] slices each."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    return total[np.concatenate(([0], np.cumsum(counts)))]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens by id, and their offsets."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in by_id])))


def decode_rows(path: str, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of ids, and the rows' offsets among the bytes."""
    flat, at = token_bytes(path)
    lengths = at[ids + 1] - at[ids]
    total = np.concatenate(([0], np.cumsum(lengths)))
    return gather(flat, at[ids], lengths), total[offsets]


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of integers without nulls."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _appended(df: DataFrame, **fields: T.DataType) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in fields]
    return T.StructType(kept + [T.StructField(k, v) for k, v in fields.items()])


Batches = Iterable[pa.RecordBatch]


def encode(docs: DataFrame, path: str, text: str = "text", then: Callable[[Batches], Iterator[pa.RecordBatch]] | None = None, then_schema: str | None = None) -> DataFrame:
    """docs with ids (array of int) and token_ends (for each token, the byte of the text at which it ends).

    then, a function on the encoded batches, runs in the same worker, so that ids needn't leave it.
    """
    schema = _appended(docs, ids=T.ArrayType(T.IntegerType(), False), token_ends=T.ArrayType(T.IntegerType(), False))

    def encoded(batches: Batches) -> Iterator[pa.RecordBatch]:
        enc, (_, at) = encoder(path), token_bytes(path)
        for batch in chunks(batches, text, 1 << 20):
            ids, offsets = enc.encode([x or "" for x in batch.column(text).to_pylist()])
            ends = np.cumsum(at[ids.astype(np.int64) + 1] - at[ids])
            before = np.concatenate(([0], ends))[offsets]
            ends = ends - np.repeat(before[:-1], np.diff(offsets))
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-2]), *lists], names=schema.names)

    if then is None:
        return docs.mapInArrow(encoded, schema)
    return docs.mapInArrow(lambda batches: then(encoded(batches)), then_schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded (binary): the bytes of its ids."""
    schema = _appended(encoded, decoded=T.BinaryType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = list_parts(batch.column("ids"))
            raw, at = decode_rows(path, ids.astype(np.int64), offsets)
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), decoded.cast(pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(path: str) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """On encoded batches: doc_id, n_tokens, and the SHA-256 of the ids (as little-endian 32-bit integers) and of the bytes they decode to."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        sha = lambda raw, at: [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for batch in batches:
            ids, offsets = list_parts(batch.column("ids"))
            raw, at = decode_rows(path, ids.astype(np.int64), offsets)
            found = sha(memoryview(ids.astype("<u4").tobytes()), 4 * offsets), sha(memoryview(raw.tobytes()), at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), *map(pa.array, found)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


# Token counts ---------------------------------------------------------------------------------------------------

#: A pre-token in more than one of so many documents of a batch is counted where it is; only the others are shuffled.
COMMON = 64
#: Bound of the parts that a batch's frequencies are dealt to, whatever the number of partitions.
MOST_BUCKETS = 1024
#: Fixed value: the special token of the vocabulary, which the library finds inside texts.
SPECIAL = "<|endoftext|>"


def _split_special(texts: list[str], special: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at the special string; the text of each part; how many specials each text has."""
    found = np.zeros(len(texts), np.int64)
    if special is None or not any(special in t for t in texts):
        return texts, np.arange(len(texts)), found
    parts, owner = [], []
    for i, t in enumerate(texts):
        cut = t.split(special)
        found[i] = len(cut) - 1
        parts += cut
        owner += [i] * len(cut)
    return parts, np.array(owner), found


def count_tokens(docs: DataFrame, path: str, special: str | None = SPECIAL) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of (doc_id, text).

    Each batch of documents becomes frequencies of pre-tokens. Those common in the batch are counted there, so no hot
    pre-token is shuffled. The rest goes to the partition of its hash; there the pieces of each distinct pre-token are
    counted once and joined to the frequencies of all documents, and sums go back to the batch, one array a partition.
    """
    n = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = {"doc_id": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64())}
    fields = ", ".join(f"{c} array<bigint>" for c in own)

    def frequencies(batches: Batches) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in chunks(batches, "text", 1 << 24):
            total, found = batch.num_rows, np.zeros(batch.num_rows, np.int64)
            table, at = Frequencies(total), 0
            for part in chunks([batch], "text", 1 << 20):
                texts = [x or "" for x in part.column("text").to_pylist()]
                pieces, owner, found[at : at + len(texts)] = _split_special(texts, special)
                names, counts = pre_tokens(pieces)
                table.add(names, np.repeat(owner + at, counts))
                at += len(texts)
            table.close()
            common = table.spread > max(1, total // COMMON)
            weight = np.zeros(len(table.names), np.int64)
            weight[common] = enc.lengths([table.names[i] for i in np.flatnonzero(common)])
            local = np.bincount(table.owner, weights=weight[table.number] * table.freq, minlength=total).astype(np.int64) + found
            first = int(batch.column("row")[0].as_py())
            _, offsets = utf8(batch.column("text"))
            lists = [pa.array([x], t) for x, t in zip((batch.column("doc_id").to_pylist(), np.diff(offsets), local), own.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([first % n], pa.int32()), pa.array([first]), pa.nulls(1, pa.binary()), *lists], names=["bucket", "batch", "blob", *own])
            buckets, blobs = table.blobs(n, first, ~common)
            if buckets:
                none = [pa.nulls(len(buckets), t) for t in own.values()]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([first] * len(buckets)), pa.array(blobs, pa.binary()), *none], names=["bucket", "batch", "blob", *own])

    def sums(batches: Batches) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            totals = []
            for blob in batch.column("blob"):
                if blob.is_valid:
                    _, names, _, number, owner, freq = unpack(blob.as_py())
                    totals.append(np.bincount(owner, weights=enc.lengths(names)[number] * freq).astype(np.int32).tobytes())
                else:
                    totals.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("batch"), pa.array(totals, pa.binary()), *(batch.column(c) for c in own)], names=["batch", "totals", *own])

    def finish(table: pa.Table) -> pa.Table:
        doc_id, n_bytes, n_tokens = (next(x.values for x in table.column(c) if x.is_valid) for c in own)
        tokens = n_tokens.to_numpy().copy()
        for x in table.column("totals"):
            if x.is_valid:
                part = np.frombuffer(x.as_buffer(), np.int32)
                tokens[: len(part)] += part
        return pa.table({"doc_id": doc_id, "n_bytes": n_bytes, "n_tokens": tokens})

    packed = rows.mapInArrow(frequencies, f"bucket int, batch bigint, blob binary, {fields}").repartition(n, "bucket")
    parts = packed.mapInArrow(sums, f"batch bigint, totals binary, {fields}")
    return parts.groupBy("batch").applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_tokens bigint")
