"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

The hashes of a text's five-word shingles are thrown once into BINS bins by their high bits and each bin keeps its
least. An empty bin b copies the first filled bin of its own probe sequence start[b] + t * stride[b] (mod BINS); the
odd stride makes it visit every bin. Of each bin, the low BITS bits are stored; two bins agree by chance with
probability 2 ** -BITS, which `likeness` takes out.

Defined results: null and empty texts, and texts of white space, have the fingerprint '' (likeness 1 among
themselves, 0 to others); texts of one to four words have one shingle, the words themselves; equal texts have equal
fingerprints; rows are fingerprinted alone, so ties and repeated rows don't matter; very long texts are one array of
hashes; an empty table gives an empty one; extra columns pass through, a column named `fingerprint` is replaced. Only
DataFrame functions are used.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK

BINS, BITS, SHINGLE = 256, 8, 5
WIDE = 1 << (BITS + 1)
#: Probes of each empty bin in the rounds of densification, before the rest of its sequence.
ROUNDS = (1, 1, 1, 1, 4, 8, 16)
_SHIFT = 63 - 8  # the bin is the top 8 of 63 bits
_LOW = (1 << _SHIFT) - 1
_KEY = "_fp_key"
#: Documents in a bucket of neighbouring ids, and the most buckets; a bucket is a unit of work for one task.
BUCKET_ROWS, MOST_BUCKETS = 128, 1 << 16


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _probes(seed: int = 7) -> tuple[list[int], list[int]]:
    rng = random.Random(seed)
    return [rng.randrange(BINS) for _ in range(BINS)], [2 * rng.randrange(BINS // 2) + 1 for _ in range(BINS)]


def with_bins(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds array column `out`: for each densified bin, in order, bin * WIDE + low bits + 1; empty for a text without words."""
    words, srt, low = (f"_{out}_{x}" for x in ("words", "sorted", "low"))
    df = df.withColumn(words, F.split(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r")), BLANK))
    # The only empty word is that of a text without words. From here on, words are their hashes.
    df = df.withColumn(words, F.when(F.get(words, F.lit(0)) != "", F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    n, word = F.size(words), F.col(words)
    positive = lambda h: h.bitwiseAND(F.lit((1 << 63) - 1))
    hashes = (
        F.when(n >= shingle, F.transform(F.sequence(F.lit(0), n - shingle), lambda i: positive(F.xxhash64(*[F.get(word, i + k) for k in range(shingle)]))))
        .when(n > 0, F.array(positive(F.xxhash64(word))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    ends = _ints((b << _SHIFT) | _LOW for b in range(BINS))  # after all hashes of their bins
    df = df.withColumn(srt, F.when(n > 0, F.sort_array(F.concat(hashes, ends)))).drop(words)
    s = F.col(srt)
    first = F.filter(s, lambda x, i: ~F.shiftright(x, _SHIFT).eqNullSafe(F.shiftright(F.get(s, i - 1), _SHIFT)))
    stored = lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) == _LOW, F.lit(0)).otherwise(x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1)
    df = df.withColumn(low, F.transform(first, lambda x, b: b * WIDE + stored(x))).drop(srt)

    start, stride = (_ints(x) for x in _probes())
    bins, found_in = F.col(low), lambda p: p.bitwiseAND(F.lit(WIDE - 1))
    donor = lambda b, t: found_in(F.get(bins, (F.get(start, b) + t * F.get(stride, b)).bitwiseAND(F.lit(BINS - 1))))
    none = F.array().cast("array<int>")
    # One probe of each empty bin in the first rounds, several in the next, then the rest of the sequence.
    empty = F.transform(F.filter(bins, lambda p: found_in(p) == 0), lambda p: F.shiftright(p, BITS + 1))
    df = df.withColumn(f"_{out}_left", empty)
    names, at, left = [], 0, F.col(f"_{out}_left")
    for t, width in enumerate((*ROUNDS, BINS - sum(ROUNDS))):
        names.append(f"_{out}_got{t}")
        probes = _ints(range(at, at + width))
        if width == 1:
            tried = F.transform(left, lambda b: b * WIDE + donor(b, F.lit(at)))  # noqa: B023
        else:
            tried = F.transform(left, lambda b: b * WIDE + F.coalesce(F.get(F.filter(F.transform(probes, lambda t: donor(b, t)), lambda v: v > 0), F.lit(0)), F.lit(0)))  # noqa: B023
        df = df.withColumn(names[-1], tried)
        df = df.withColumn(f"_{out}_left", F.transform(F.filter(names[-1], lambda p: found_in(p) == 0), lambda p: F.shiftright(p, BITS + 1)))
        at += width
    full = F.filter(F.concat(bins, *names), lambda p: found_in(p) > 0)
    return df.withColumn(out, F.coalesce(F.sort_array(full), none)).drop(low, *names, f"_{out}_left")


def packed(bins: Column) -> Column:
    """The bins as lower-case hexadecimal digits, two a bin."""
    digits = F.array(*[F.lit(f"{v:02x}") for v in (0, *range(1 << BITS))])
    return F.array_join(F.transform(bins, lambda p: F.get(digits, p.bitwiseAND(F.lit(WIDE - 1)))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two texts' shingle sets from their bins, chance agreement taken out, in 0 to 1."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(BINS)
    chance = 1.0 / (1 << BITS)
    both = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (agree - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `fingerprint`."""
    return with_bins(docs, text, "_bins").withColumn("fingerprint", packed(F.col("_bins"))).drop("_bins")


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with bucket, edge and next_text, the text of the next document by id (ties: by text), cyclically.

    Ids are cut into buckets at approximate quantiles; a bucket is sorted alone, and the first row of each bucket is
    also dealt, marked as edge, to the end of the bucket before. So no task sees more than its buckets, and a row's
    text moves once.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(_KEY))
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds = []
    if buckets > 1:
        bounds = docs.agg(F.percentile_approx(_KEY, [i / buckets for i in range(1, buckets)], 8 * buckets)).first()[0]
    if bounds:
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        edges_ = _ints(bounds)
        at = F.aggregate(_ints(steps), F.lit(0), lambda pos, step: pos + F.when(F.get(edges_, pos + step - 1) <= F.col(_KEY), step).otherwise(F.lit(0)))
    else:
        at = F.lit(0)
    docs = docs.withColumn("bucket", at)
    # One row a bucket: at most MOST_BUCKETS, hence the broadcast and the single window.
    firsts = docs.groupBy("bucket").agg(F.min(_KEY).alias("first_key"))
    prev = F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), F.max("bucket").over(W.partitionBy()))
    firsts = firsts.withColumn("prev", prev).select("first_key", "prev")
    edges = docs.join(F.broadcast(firsts), F.col(_KEY) == F.col("first_key")).select("doc_id", "text", _KEY, F.col("prev").alias("bucket"))
    edges = edges.groupBy("bucket", _KEY).agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    rows = docs.select("doc_id", "text", _KEY, "bucket", F.lit(False).alias("edge")).unionByName(edges.withColumn("edge", F.lit(True)))
    return rows.withColumn("next_text", F.lead("text").over(bucket_order()))


def bucket_order():
    return W.partitionBy("bucket").orderBy("edge", _KEY, "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """For every document its own fingerprint, that of its text with the second half replaced by the start of the next document's, and the likeness of the first to both."""
    rows = with_next_text(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_bins(rows, "text", "bins").withColumn("next_bins", F.lead("bins").over(bucket_order()))
    rows = rows.filter("not edge").drop("text", "next_text")
    rows = with_bins(rows, "edited", "edited_bins")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
