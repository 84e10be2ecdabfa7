"""Words in passages that documents share: runs of WORDS words or more that a document of another id holds too.

The contexts of `repeats`, with words for bytes: every window of WORDS words has an anchor, the least hash among its
GRAM-word grams, and the windows that share an anchor form a context. Anchors of one document alone go.
Contexts that two documents hold are shared as a whole. Of anchors whose contexts agree in part, one context of each kind
is fetched and its windows are counted by hash.
All windows of a context hold its anchor, so the shared ones cover one stretch.

Words, stretches and windows count as equal if their 64-bit hashes are. Blanks between words don't count.

Defined results: null texts are empty; documents under WORDS words, or without a shared run, have no row; an empty table
gives an empty one; rows without an id are one document; rows of one id are one document, and get one figure.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, release, temporary, utf8
from .repeats import Hasher, contexts

#: A passage of over 50 words.
WORDS, GRAM = 51, 5


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the offsets of the rows among the words."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    breaks = np.zeros(n + 1, bool)  # rows end words
    breaks[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | breaks))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | breaks))
    return Hasher(raw).of(start, stop), np.searchsorted(start, offsets)


def shared(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shared_words): for each document with shared passages, the words that these cover."""
    with temporary(docs.sparkSession):
        return materialize(_shared(docs, words), stay=True)


def _shared(docs: DataFrame, words: int) -> DataFrame:
    spark, gram = docs.sparkSession, min(GRAM, words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 21):
            c = contexts(*word_hashes(*utf8(batch.column("text"))), words, gram)
            arrays = [pa.array(c["anchor"]), pa.array(c["ctx"]), batch.column("doc_id").take(pa.array(c["row"])), pa.array(c["first"].astype(np.int32)), pa.array(c["size"].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "ctx", "doc_id", "first", "size"])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks([whole], "text", 1 << 20):
                hashes, offsets = word_hashes(*utf8(batch.column("text")))
                hasher, parts = Hasher(hashes), batch.column("parts")
                row = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
                ctx, first, size, other = (parts.flatten().field(k).to_numpy() for k in ("ctx", "first", "size", "other"))
                fits = np.flatnonzero(offsets[row] + first + size <= offsets[row + 1])
                begin = offsets[row[fits]] + first[fits]
                fits = fits[hasher.of(begin, begin + size[fits]).view(np.int64) == ctx[fits]]  # an id's other texts don't hold the part
                count = size[fits] - words + 1
                part = np.repeat(fits, count)
                at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                begin = offsets[row[part]] + first[part] + at
                low = batch.column("doc_id").take(pa.array(row[part]))
                arrays = [pa.array(hasher.of(begin, begin + words).view(np.int64)), low, pa.array(other[part]), pa.array(ctx[part]), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "doc_id", "other", "ctx", "at"])

    none = -(1 << 63)  # stands for the missing id
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(none)))
    rows = materialize(docs.mapInArrow(cut, "anchor bigint, ctx bigint, doc_id bigint, first int, size int"))
    met = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("anchor")
    rows = materialize(rows.join(met.hint("shuffle_hash"), "anchor", "left_semi"))  # most anchors lie in one document
    same = materialize(rows.groupBy("anchor", "ctx").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other"), F.min_by("first", "doc_id").alias("first"), F.min("size").alias("size")))
    release(spark)
    partly = same.filter("doc_id = other").select("anchor").distinct()
    parts = same.join(partly, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("ctx", "first", "size", "other")).alias("parts"))
    every = materialize(docs.join(parts, "doc_id").select("doc_id", "text", "parts").mapInArrow(windows, "h bigint, doc_id bigint, other bigint, ctx bigint, at int"))
    release(spark)
    twice = every.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("other").alias("b")).filter("a != b").select("h")
    hits = every.filter("doc_id = other").join(twice.hint("shuffle_hash"), "h", "left_semi").groupBy("ctx").agg(F.min("at").alias("from"), (F.max("at") + words).alias("to"))
    whole = same.filter("doc_id != other").select("ctx", F.lit(0).alias("from"), F.col("size").alias("to"))
    spans = rows.select("ctx", "doc_id", "first").join(whole.unionByName(hits).hint("shuffle_hash"), "ctx").select("doc_id", F.struct((F.col("first") + F.col("from")).alias("start"), (F.col("first") + F.col("to")).alias("stop")).alias("span"))
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n")), lambda s: s["n"],
    )
    return spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans")).select(F.when(F.col("doc_id") != none, F.col("doc_id")).alias("doc_id"), covered.alias("n_shared_words"))
