"""Language identification by language-bitmask n-gram filters.

The n-grams typical of each language go into Bloom filters that are bit-sliced: position i of the table holds one bit
per language, so the positions of an n-gram's hashes, combined by AND, give all languages that contain it at once.
Per language, the n-grams of a text that are contained are counted, the false positives expected from the filter's
filling are taken out, and the largest count decides.

Fitting uses a bounded sample of each language's rows (SAMPLE, by hash of the id); prediction covers every row.

Defined results: null texts and texts without a letter are `und` with score 0; equal counts go to the first language by
code point; without any learned language all is `und`; rows are judged alone, so repeated rows don't matter; very long
texts are one slice of their own; an empty table gives an empty one; extra columns pass through, those named lang_pred or
score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, mix64, per_row
from .ngrams import hashes, lower_letters, spaced

ORDERS = (3, 4)
#: Rows of each language that the filters are fitted on, about.
SAMPLE = 3000
#: An n-gram belongs to a language if so many of its documents, and so large a share of the largest share, have it.
LEAST_DOCS, LEAST_SHARE = 3, 0.2
HASHES = 3
UNKNOWN = "und"


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # (words of 64 languages or fewer, positions)
    false_rate: np.ndarray  # of each language

    def bits(self, h: np.ndarray) -> np.ndarray:
        """Languages containing each hashed n-gram, as bit masks: (words, n)."""
        mask = np.uint64(self.table.shape[1] - 1)
        out = None
        for k in range(HASHES):
            got = self.table[:, ((h >> np.uint64(20 * k)) & mask).astype(np.int64)]
            out = got if out is None else out & got
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from (doc_id, text, lang); rows without a language are left out."""
    docs = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Filters([], np.zeros((1, 2), np.uint8), np.zeros(0))
    share = F.element_at(F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))]), F.col("lang"))
    u = F.xxhash64("doc_id", F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    chosen = docs.filter(u < share).select("lang", "text")
    number = {k: i for i, k in enumerate(names)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            points, row, _ = spaced(batch.column("text"), lower_letters())
            for n in ORDERS:
                h, inside = hashes(points, n)
                h, of = h[inside], row[: len(inside)][inside]
                pairs = np.unique(mix64(h) ^ of.astype(np.uint64), return_index=True)[1]  # once a document
                for lang in np.unique(langs):
                    own = pairs[langs[np.minimum(of[pairs], len(langs) - 1)] == lang]
                    found, docs_ = np.unique(h[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), lang, np.int32)), pa.array(found.view(np.int64)), pa.array(docs_.astype(np.int64))], names=["lang", "gram", "docs"])

    grams = chosen.mapInArrow(count, "lang int, gram bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    found = grams.toPandas()  # bounded by the sample
    used = np.array([min(sizes[k], sample) for k in names], float)
    gram, lang = found["gram"].to_numpy(np.int64).view(np.uint64), found["lang"].to_numpy(np.int64)
    rate = found["docs"].to_numpy(float) / used[lang]
    distinct, place = np.unique(gram, return_inverse=True)
    most = np.zeros(len(distinct))
    np.maximum.at(most, place, rate)
    typical = rate >= LEAST_SHARE * most[place]
    per_word = 64
    size = 1 << max(10, int(np.ceil(np.log2(max(1, 10 * len(distinct))))))
    words = -(-len(names) // per_word)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(names), per_word) <= 8 * np.dtype(t).itemsize)
    table = np.zeros((words, size), kind)
    for k in range(HASHES):
        at = ((gram[typical] >> np.uint64(20 * k)) & np.uint64(size - 1)).astype(np.int64)
        np.bitwise_or.at(table, (lang[typical] // per_word, at), (np.uint64(1) << (lang[typical] % per_word).astype(np.uint64)).astype(kind))
    filled = np.array([np.count_nonzero(table[i // per_word] & kind(1 << (i % per_word))) / size for i in range(len(names))])
    return Filters(names, table, filled**HASHES)


def predict(docs: DataFrame, filters: Filters, keep_text: bool = False) -> DataFrame:
    """The columns of docs (text itself only if asked for), lang_pred and score (the share of a text's n-grams that the language contains, corrected)."""

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score") and (keep_text or f.name != "text")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            points, _, at = spaced(batch.column("text"), lower_letters())
            letters = per_row((points != 0)[1:], at)
            n_langs = len(filters.languages)
            total, hits = np.zeros(batch.num_rows), np.zeros((n_langs, batch.num_rows))
            for n in ORDERS if n_langs else ():
                h, inside = hashes(points, n)
                bits = filters.bits(h)
                pad = np.zeros(len(points) - len(h), bool)
                inside = np.append(inside, pad)
                total += per_row(inside[: at[-1]], at)
                for i in range(n_langs):
                    word = bits[i // 64]
                    got = np.append((word >> word.dtype.type(i % 64)) & word.dtype.type(1), pad).astype(bool) & inside
                    hits[i] += per_row(got[: at[-1]], at)
            false = filters.false_rate[:, None]
            fixed = np.clip((hits - total * false) / (1 - np.minimum(false, 0.999)), 0, None)
            best = fixed.argmax(0) if n_langs else np.zeros(batch.num_rows, np.int64)
            known = (letters > 0) & (n_langs > 0)
            score = np.where(known, np.minimum(1, fixed.max(0, initial=0) / np.maximum(total, 1)), 0.0) if n_langs else np.zeros(batch.num_rows)
            pred = [filters.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(pred, pa.string()), pa.array(score)], names=schema.names)

    return docs.mapInArrow(run, schema)
