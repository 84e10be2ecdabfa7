"""Mixing sources to target weights by Pareto order sampling.

Every document of a source gets the whole copies that are certain, floor(target / source size). The rest of the
target is a fixed-size (in words) unequal-probability sample: documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u a hash of the id and p the inclusion probability, and the lowest ranks are taken
up to the target. The cut is found from a histogram of ranks per source, so a hot source is never sorted in one task.
What a source then lacks, as the prefix of ranks stops at a document that doesn't fit, is filled by up to FILLS further
documents, none longer than what is lacking, so a fill never overshoots: of each class of sizes (CLASSES an octave) the
first by rank are candidates, and the longest that still fits is taken, again and again. These few documents of a source are
taken for their size first and their rank second; all others keep the odds of the Pareto order.

Defined results: null texts have size 0; a null source is a source of its own and comes last; repeated rows count
each; a source of size 0 has target 0 and takes nothing; an empty table gives an empty table; other columns of the
input are kept by `mix`, but for those named size, source_size, target or copies, which keep the input's values; very
long texts count whole; documents of equal rank follow by id, size and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Bins of the rank histogram of a source; the bin at the cut alone is sorted.
BINS = 4096
#: Up to so many sources their table is broadcast, beyond it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Documents that may fill what a source lacks after the cut, and classes of sizes in an octave that candidates come from.
FILLS, CLASSES = 3, 8


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per source: size, mean log size, target. Targets share all sizes by weight, cut at cap times the source's size, the excess reshared by weight.

    With caps sorted by cap / weight, the water level c of the first row that isn't capped solves
    sum of caps before + c * (weights from here on) = total; the first row with c <= cap / weight has it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.log1p("size")).alias("mean_log"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    order = W.orderBy("level", F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("after", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("c", (F.col("total") - F.col("before")) / F.col("after"))
    )
    water = F.min_by(F.when(F.col("c") <= F.col("level"), F.col("c")), F.when(F.col("c") <= F.col("level"), F.col("level"))).over(whole)
    return per.withColumn("target", F.least(F.col("most"), F.coalesce(water * F.col("weight"), F.col("most")))).select("source", "source_size", "mean_log", "target")


def _rank(size: Column, share: Column, mean_log: Column, doc_id: Column, seed: int) -> Column:
    """The Pareto rank as q / (1 + q), in (0, 1). Inclusion rises with the log of the size: 1 - (1 - share) ** (log size / mean log size)."""
    u = (F.xxhash64(doc_id, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    p = 1 - F.pow(1 - share, F.greatest(F.log1p(size) / mean_log, F.lit(1e-3)))
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(share > 0, q / (1 + q))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 11, columns: list[str] | None = None) -> DataFrame:
    """docs (or the given columns of it) with size, source_size, target, copies."""
    columns = docs.columns if columns is None else columns
    keep = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(columns)]
    rows = docs.select(*keep, "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = materialize(rows.select("doc_id", "source", "size", "text_hash"))
    if set(columns) <= {"doc_id", "source"}:  # then the texts needn't be read again
        rows = sized.select(*keep, "doc_id", "source", "size", "text_hash")
    targets = materialize(source_targets(sized, weights, cap))
    few = targets.count() <= BROADCAST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    def ranked(df: DataFrame, per: DataFrame) -> DataFrame:
        per = per.withColumnRenamed("source", "_source")
        joined = df.join(small(per), df["source"].eqNullSafe(per["_source"])).drop("_source")
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        joined = joined.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("share", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
        joined = joined.withColumn("rank", _rank(F.col("size"), F.when(F.col("share") > 1e-9, F.col("share")).otherwise(F.lit(0.0)), F.col("mean_log"), F.col("doc_id"), seed))
        return joined.withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))

    # The bin of each source in which the words that remain run out; a few rows per source.
    hist = ranked(sized, targets).filter("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first(F.col("share") * F.col("source_size")).alias("rest"))
    upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = hist.withColumn("upto", F.sum("words").over(upto)).filter(F.col("upto") >= F.col("rest"))
    cut = hist.groupBy("source").agg(F.min_by(F.struct(F.col("bin").alias("cut_bin"), (F.col("rest") - F.col("upto") + F.col("words")).alias("room")), "bin").alias("cut")).select("source", "cut.*")
    cut = cut.withColumnRenamed("source", "_s")
    per = targets.join(small(cut), targets["source"].eqNullSafe(cut["_s"]), "left").drop("_s")
    per = materialize(per)

    # Only the documents in that bin are ordered; identical rows are interchangeable.
    edge = ranked(sized, per).filter("bin = cut_bin")
    order = W.partitionBy("source", "bin").orderBy("rank", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = edge.withColumn("fits", F.sum("size").over(order) <= F.col("room"))
    key = ("doc_id", "source", "text_hash")
    edge = materialize(edge.filter("fits").groupBy(*key).agg(F.count("*").alias("extra"), F.sum("size").alias("words")).select(*key, "extra", "words"))
    gaps = per.filter("cut_bin is not null").join(small(edge.groupBy(F.col("source").alias("_s")).agg(F.sum("words").alias("taken"))), F.col("source").eqNullSafe(F.col("_s")), "left")
    gaps = gaps.select(F.col("source").alias("_gs"), (F.col("room") - F.coalesce("taken", F.lit(0))).alias("gap"))
    spare = ranked(sized, per).filter("rank is not null and bin >= cut_bin and size > 0")
    spare = spare.join(small(gaps), F.col("source").eqNullSafe(F.col("_gs"))).filter("size <= gap")
    spare = spare.groupBy(*key).agg(F.sum("size").alias("words"), F.count("*").alias("extra"), F.first("rank").alias("rank"), F.first("gap").alias("gap")).filter("words <= gap")
    spare = spare.join(edge.select(*[F.col(c).alias(f"_e_{c}") for c in key]), (F.col("doc_id").eqNullSafe(F.col("_e_doc_id"))) & F.col("source").eqNullSafe(F.col("_e_source")) & (F.col("text_hash") == F.col("_e_text_hash")), "left_anti")
    # A bounded number of candidates a source: FILLS of each class of sizes.
    first = F.row_number().over(W.partitionBy("source", F.floor(F.log2("words") * CLASSES)).orderBy("rank", "doc_id", "text_hash"))
    spare = spare.withColumn("place", first).filter(F.col("place") <= FILLS)
    item = F.struct((-F.col("words")).alias("less"), "rank", "doc_id", "text_hash", "extra", "words")
    lists = spare.groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("gap").alias("gap"))
    start = F.struct(F.col("gap").cast("long").alias("gap"), F.slice("items", 1, 0).alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        fits = (x["words"] <= acc["gap"]) & (F.size(acc["taken"]) < FILLS)
        return F.struct(F.when(fits, acc["gap"] - x["words"]).otherwise(acc["gap"]).cast("long").alias("gap"), F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"))

    best = lists.select("source", F.explode(F.aggregate("items", start, take)["taken"]).alias("b")).select("source", "b.doc_id", "b.text_hash", "b.extra", "b.words")
    edge = materialize(edge.unionByName(best.select(*key, "extra", "words")))
    edge = edge.select(*[F.col(c).alias(f"_e_{c}") for c in key], "extra")

    out = ranked(rows, per)
    same = out["doc_id"].eqNullSafe(edge["_e_doc_id"]) & out["source"].eqNullSafe(edge["_e_source"]) & (out["text_hash"] == edge["_e_text_hash"])
    out = out.join(edge, same, "left")
    # Identical rows at the cut are taken together.
    below = F.col("rank").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")))
    taken = F.col("whole") + F.when(below, 1).when(F.col("extra").isNotNull(), 1).otherwise(0)
    named = [F.col(f"_in_{i}").alias(c) for i, c in enumerate(columns)]
    extra = [F.col("size").alias("size"), F.col("source_size"), F.col("target"), F.least(taken, F.lit(int(cap))).cast("long").alias("copies")]
    return out.select(*named, *[c for c, n in zip(extra, ("size", "source_size", "target", "copies")) if n not in columns])


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as its copies; the input's columns."""
    columns = docs.columns
    mixed = mix(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], "doc_id", "source", "text"), columns=[f"c{i}" for i in range(len(columns))], **options)
    mixed = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
