"""LM scoring by subword lattice likelihood, beside an add-one word model.

The pieces of an existing vocabulary span a lattice over each word (with its leading word mark); a forward recursion in
log space sums over all segmentations. A text is its words and one end; as the mark begins a word, the lattices of a
text's words are independent, and its marginal probability is the product of theirs and of the end's. The score is that
marginal alone. The vocabulary's scores start the piece probabilities; ROUNDS of expectation over the training words
(forward and backward over the same lattices, all counts, no sample) fit them to the corpus. Characters without a piece
of their own go through the vocabulary's byte pieces, so every text has a probability.

Both models need words' counts over the whole corpus: batches of documents are packed into word frequencies, shuffled by
hash of the word into at most MOST_BUCKETS buckets, each distinct word is one row that is counted and scored once, and
sums by row come back. A worker holds the distinct words of one bucket and streams the frequencies past them.

Defined results: null and empty texts are one end; ids decide by their text form which rows are learned from (null: the
empty text); repeated rows are learned from and scored each; an empty training set gives the base score
log10(1 / 1) = 0 a token and the vocabulary's own scores for the lattice, with an end half of the time; an empty table
gives an empty one; very long texts are one batch of their own, very long words are scored in lattices of their own;
columns besides doc_id and text, whatever their names, are ignored; ties don't occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, chunks, materialize, mix64, py_remainder
from .frequencies import Frequencies, unpack

MARK = "▁"
ROUNDS, PRIOR = 3, 0.1
_WORDS = re.compile(WORD)
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_SLOTS = 20
#: Bound of the parts that a batch is dealt to, whatever the number of partitions.
MOST_BUCKETS = 1024


class Vocabulary:
    """Pieces by hash of their code points; byte pieces; the scores that the file gives, as log probabilities."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        scores = np.array([model.get_score(i) for i in range(n)])
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # A merge's score is minus its rank: by Zipf's law its probability falls as the rank. Pieces without a rank come last.
        rank = np.where((scores < 0) & (scores > -1e8), -scores, n)
        weight = np.where(np.isin(np.arange(n), [*normal, *self.bytes]), 1 / (rank + 2), 0)
        self.usable = weight > 0
        with np.errstate(divide="ignore"):
            self.first = np.log(weight / weight.sum())
        pieces = [model.id_to_piece(i) for i in normal]
        self.longest = max(map(len, pieces))
        hashed = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = np.zeros(1, np.uint64)
                for c in p:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(c))
                hashed[i] = mix64(h)[0]
        # Two tables by different bits of the hash; what finds its slot taken goes to the second.
        self.tables = []
        left = np.arange(len(pieces))
        for shift in (0, 24, 44):
            slot = ((hashed[left] >> np.uint64(shift)) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            ids, keys = np.full(1 << _SLOTS, -1, np.int32), np.zeros(1 << _SLOTS, np.uint64)
            ids[slot[first]] = np.array(normal)[left[first]]
            keys[slot[first]] = hashed[left[first]]
            self.tables.append((shift, ids, keys))
            left = np.delete(left, first)
            if not len(left):
                break
        assert not len(left)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashed strings, -1 where there is none."""
        out = np.full(h.shape, -1, np.int32)
        for shift, ids, keys in self.tables:
            slot = ((h >> np.uint64(shift)) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)
            hit = (keys[slot] == h) & (ids[slot] >= 0)
            out[hit] = ids[slot[hit]]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_length(words: list[str], budget: int) -> Iterator[tuple[np.ndarray, int]]:
    """Words of about equal length, few enough that their lattices fit the budget; their padded length."""
    if not words:
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    padded = np.where(lengths <= 24, lengths, -(-lengths // 16) * 16)
    order = np.argsort(padded, kind="stable")
    cut = np.flatnonzero(np.diff(padded[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        size = int(padded[order[a]])
        step = max(1, budget // (16 * size))
        for k in range(a, b, step):
            yield order[k : min(b, k + step)], size


def lattice(vocab: Vocabulary, logp: np.ndarray, words: list[str], counts: np.ndarray | None = None, budget: int = 1 << 20) -> tuple[np.ndarray, np.ndarray | None]:
    """The log probability of each word, and with counts the expected number of uses of each piece."""
    out = np.zeros(len(words))
    expected = None if counts is None else np.zeros(vocab.size)
    most = vocab.longest
    for at, size in _by_length(words, budget):
        w = len(at)
        chars = np.zeros((size, w), np.uint64)
        lengths = np.array([len(words[i]) for i in at]) + 1
        chars[0] = ord(MARK)
        flat = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
        col = np.repeat(np.arange(w), lengths - 1)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(lengths - 1) - (lengths - 1), lengths - 1) + 1
        chars[row, col] = flat
        ids = np.full((size, most, w), -1, np.int32)  # of the piece that ends before position j + 1 with l + 1 code points
        h = np.zeros((size, w), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(most, size) + 1):
                h = h[: size - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :]
                ids[n - 1 :, n - 1] = vocab.find(mix64(h))
        weight = np.where(ids >= 0, logp[ids], -np.inf)
        lone = np.argwhere((ids[:, 0] < 0) & (chars > 0))  # characters without a piece: their bytes
        lone_bytes = [vocab.bytes[list(chr(int(chars[j, k])).encode("utf-8", "surrogatepass"))] for j, k in lone]
        for (j, k), b in zip(lone, lone_bytes, strict=True):
            weight[j, 0, k] = logp[b].sum()
        alpha = np.full((size + most + 1, w), -np.inf)  # alpha[most + j]: all ways to the position after j code points
        alpha[most] = 0
        for j in range(size):
            terms = alpha[j + 1 : j + most + 1][::-1] + weight[j]
            top = terms.max(0)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[most + j + 1] = safe + np.log(np.exp(terms - safe).sum(0))
        total = alpha[most + lengths, np.arange(w)]
        out[at] = total
        if counts is None:
            continue
        beta = np.full((size + most + 1, w), -np.inf)
        beta[lengths, np.arange(w)] = 0
        steps = np.arange(most)
        for j in range(size - 1, -1, -1):
            # pieces that begin at j: of n + 1 code points, ending before j + n + 1
            ends = j + steps
            inside = ends < size
            terms = np.where(inside[:, None], weight[np.minimum(ends, size - 1), steps] + beta[j + 1 : j + most + 1], -np.inf)
            top = np.maximum(terms.max(0), beta[j])
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                beta[j] = safe + np.log(np.exp(terms - safe).sum(0) + np.exp(beta[j] - safe))
        scale = counts[at]
        for n in range(min(most, size)):
            with np.errstate(invalid="ignore"):
                post = np.exp(alpha[most : most + size - n] + weight[n:, n] + beta[n + 1 : size + 1] - total) * scale
            post = np.nan_to_num(post)
            has = ids[n:, n] >= 0
            expected += np.bincount(ids[n:, n][has], weights=post[has], minlength=vocab.size)
            if n == 0:
                for (j, k), b in zip(lone, lone_bytes, strict=True):
                    np.add.at(expected, b, post[j, k])
    return out, expected


_OWN = {"doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "n_words": pa.list_(pa.int64())}
_OWN_SCHEMA = "doc_id array<bigint>, held_out array<boolean>, n_words array<bigint>"


def _packed(docs: DataFrame, modulus: int, held: int, buckets: int) -> DataFrame:
    """For each batch of documents a row (batch, doc_id, held_out, n_words) of arrays and, for each bucket of its words, a blob of frequencies with training counts."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["bucket", "batch", "blob", *_OWN]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 24):
            first, ids = int(batch.column("row")[0].as_py()), batch.column("doc_id").to_pylist()
            held_out = np.array([py_remainder(x, modulus) == held for x in ids])
            table, n_words, at = Frequencies(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for part in chunks([batch], "text", 1 << 21):
                found = [_WORDS.findall((text or "").translate(_LOWER)) for text in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                n_words[at : at + len(found)] = sizes
                table.add([w for words in found for w in words], np.repeat(np.arange(at, at + len(found)), sizes))
                at += len(found)
            table.close()
            train = np.bincount(table.number, weights=table.freq * ~held_out[table.owner], minlength=len(table.names))
            used, blobs = table.blobs(buckets, first, np.ones(len(table.names), bool), train)
            lists = [pa.array([x], t) for x, t in zip((ids, held_out, n_words), _OWN.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([first % buckets], pa.int32()), pa.array([first]), pa.nulls(1, pa.binary()), *lists], names=names)
            if used:
                none = [pa.nulls(len(used), t) for t in _OWN.values()]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([first] * len(used)), pa.array(blobs, pa.binary()), *none], names=names)

    return rows.mapInArrow(run, f"bucket int, batch bigint, blob binary, {_OWN_SCHEMA}")


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a distinct word, with its training count, from blobs in the order of their buckets."""
    now: int | None = None
    total: dict[str, int] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        words, counts = list(total), np.fromiter(total.values(), np.int64, len(total))
        for k in range(0, len(words), 50_000):
            part = pa.array(words[k : k + 50_000], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now, np.int32)), part, pa.array(counts[k : k + 50_000])], names=["bucket", "word", "uses"])

    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if bucket != now:
                yield from rows()
                now, total = bucket, {}
            _, names, weights, *_ = unpack(blob.as_py())
            for w, c in zip(names, weights.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
    yield from rows()


def score(docs: DataFrame, path: str, modulus: int = 7, held: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = materialize(_packed(docs, modulus, held, min(n, MOST_BUCKETS)))
    blobs = packed.filter("blob is not null").select("bucket", "batch", "blob")
    own = packed.filter("blob is null").select("batch", *_OWN)
    learned = own.select(F.explode(F.arrays_zip("held_out", "n_words")).alias("x")).filter("not x.held_out")
    size = learned.agg(F.count("*").alias("docs"), F.coalesce(F.sum("x.n_words"), F.lit(0)).alias("words")).first()
    types = blobs.select("bucket", "blob").repartition(n, "bucket").sortWithinPartitions("bucket")
    types = materialize(types.mapInArrow(_count_words, "bucket int, word string, uses bigint"))
    seen = types.filter("uses > 0").select("word", "uses")
    tokens = size["words"] + size["docs"]
    distinct = seen.count() + (size["docs"] > 0)
    vocab = vocabulary(path)
    logp = _maximized(vocab, np.exp(vocab.first), 1.0) if not tokens else np.append(vocab.first, -np.inf)
    for _ in range(rounds if tokens else 0):
        logp = _maximized(vocab, _expected(seen, path, logp), size["docs"])

    def marginals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = lattice(vocabulary(path), logp, batch.column("word").to_pylist())[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found / np.log(10))], names=["bucket", "word", "uses", "marginal"])

    sums_of = ("n_known", "base_score", "score")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each blob the sums of its rows; a bucket's words come before its blobs."""
        now: int | None = None
        number: dict[str, int] = {}
        held_parts: list[tuple[np.ndarray, np.ndarray]] = []
        uses = marginal = np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, is_word = batch.column("bucket").to_numpy(), batch.column("word").is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (is_word[1:] != is_word[:-1]))))
            for i, j in zip(cut, [*cut[1:], len(bucket)], strict=True):
                if bucket[i] != now:
                    now, number, held_parts = bucket[i], {}, []
                part = batch.slice(i, j - i)
                if is_word[i]:
                    first = len(number)
                    number.update(zip(part.column("word").to_pylist(), range(first, first + part.num_rows), strict=True))
                    held_parts.append((part.column("uses").to_numpy(), part.column("marginal").to_numpy()))
                    continue
                if held_parts:
                    uses, marginal = (np.concatenate(x) for x in zip(*held_parts, strict=True))
                    held_parts = []
                base = np.log10((uses + 1) / (tokens + distinct + 1))
                out: dict[str, list] = {k: [] for k in sums_of}
                for blob in part.column("blob"):
                    _, words, _, entry, owner, freq = unpack(blob.as_py())
                    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))[entry]
                    for k, x in zip(sums_of, (freq * (uses[at] > 0), freq * base[at], freq * marginal[at]), strict=True):
                        out[k].append(np.bincount(owner, weights=x).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("batch"), *(pa.array(out[k], pa.binary()) for k in sums_of)], names=["batch", *sums_of])

    known_end = int(size["docs"] > 0)
    end_base, end = float(np.log10((size["docs"] + 1) / (tokens + distinct + 1))), float(logp[-1] / np.log(10))

    def finish(table: pa.Table) -> pa.Table:
        doc_id, held_out, n_words = (next(x.values for x in table.column(c) if x.is_valid) for c in _OWN)
        total = {k: np.full(len(doc_id), x) for k, x in zip(sums_of, (known_end, end_base, end), strict=True)}
        for k in sums_of:
            for x in table.column(k):
                if x.is_valid:
                    part = np.frombuffer(x.as_buffer(), np.float64)
                    total[k][: len(part)] = total[k][: len(part)] + part
        return pa.table({"doc_id": doc_id, "held_out": held_out, "n_tokens": n_words.to_numpy() + 1, "n_known": total["n_known"].astype(np.int64), "train_tokens": np.full(len(doc_id), int(tokens)), "base_score": total["base_score"].astype(float), "score": total["score"].astype(float)})

    words = types.mapInArrow(marginals, "bucket int, word string, uses bigint, marginal double")
    both = words.unionByName(blobs, allowMissingColumns=True).repartition(n, "bucket").sortWithinPartitions("bucket", F.col("word").isNull())
    parts = both.mapInArrow(sums, "batch bigint, n_known binary, base_score binary, score binary")
    together = own.unionByName(parts, allowMissingColumns=True)
    return together.groupBy("batch").applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _expected(seen: DataFrame, path: str, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all training words (word, uses); as many numbers as the vocabulary has pieces."""
    size = vocabulary(path).size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += lattice(vocabulary(path), logp, batch.column("word").to_pylist(), batch.column("uses").to_numpy().astype(float))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    found = seen.mapInArrow(run, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
    out = np.zeros(size)
    out[found["piece"].to_numpy(np.int64)] = found["uses"].to_numpy(float)
    return out


def _maximized(vocab: Vocabulary, uses: np.ndarray, ends: float) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end; the first piece of each word carries the mark, so words end by themselves."""
    uses = np.append(np.where(vocab.usable, uses + PRIOR, 0), ends + PRIOR)
    with np.errstate(divide="ignore"):
        return np.log(uses / uses.sum())
