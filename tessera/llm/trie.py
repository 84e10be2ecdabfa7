"""Trie of conversation prefixes, screened by a count-min sketch of prefix digests.

A turn's role and text become two 64-bit hashes before anything is shuffled. The digest of a prefix is the exclusive or of
its turns' hashes, each mixed with its position: 128 bits, which stand for the sequence (two different prefixes agree with a
chance of about 2**-128). All prefixes are counted in a sketch of four lines of counters; where one of a prefix's counters
says one, the prefix is a singleton for certain, and so are all longer ones of its conversation. These tails are emitted
from the conversation's own rows; only possibly shared prefixes, and one stub a conversation, are grouped exactly.

Subtree sums need no walk over the levels. A node is represented by its smallest member; the nodes a conversation
represents are a chain of growing depth. A node's sum is that of the whole chains of its members, less the part of its
own representative's chain above it. Leaves are counted as the members that represent one.

The sketch grows with the prefixes up to MOST_CELLS a line (16 MB of bits are broadcast, at most). Beyond, it proves
fewer singletons, and the exact grouping, which is distributed, takes over more of them; results never depend on it.

Running values of a conversation are formed in blocks of BLOCK turns, and then over the blocks, so a conversation that
holds a third of all rows isn't one task's, unless its turns lie thinly (each in a block of its own). The list of members that end at a node is packed from sorted
ranges, and a hash runs over the packs, never holding the list.

Defined results: rows with a null conv_id take no part; a null turn comes first; rows of one conversation and turn
follow by their hashes, repeated rows are turns of their own; null role or text is empty; very long texts count whole;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Turns of a block of running values.
BLOCK = 1024
#: Lines of the sketch; counters of a line, for each prefix, and at most.
LINES, CELLS, MOST_CELLS = 4, 4, 1 << 25

NODE = ["pos", "d1", "d2"]


def _running(rows: DataFrame, key: str, block: str, order: list, columns: list[str], xor: bool = False) -> DataFrame:
    """columns replaced by their running sum (or exclusive or) along a key: within blocks, and what the blocks before hold."""
    fold = F.bit_xor if xor else F.sum
    within = W.partitionBy(key, block).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(key, block).agg(*[fold(c).alias(c) for c in columns])
    totals = totals.select(key, block, *[fold(c).over(before).alias(f"_before_{c}") for c in columns]).filter(F.col(f"_before_{columns[0]}").isNotNull())
    rows = rows.withColumns({c: fold(c).over(within) for c in columns}).join(totals, [key, block], "left")
    for c in columns:
        held = F.coalesce(f"_before_{c}", F.lit(0).cast("long"))
        rows = rows.withColumn(c, F.col(c).bitwiseXOR(held) if xor else F.col(c) + held)
    return rows.drop(*[f"_before_{c}" for c in columns])


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 (hashes of role and text), n_bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"), F.lit(1).cast("long").alias("pos"),
    )
    numbered = _running(rows, "conv_id", "block", [F.col("turn").asc_nulls_first(), "h1", "h2"], ["pos"])
    return numbered.select("conv_id", "pos", "h1", "h2", "n_bytes")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv_id, length) after each conversation c took its first h turns from c - c % every, h = crc32(c) % most."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % every
    own = own.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    lengths = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.join(lengths, "base", "left").withColumn("p", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "p", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    # A base gives fewer than `most` turns to each of fewer than 2 * every conversations.
    heads = turns.filter((F.col("pos") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").filter("pos <= p").select("conv_id", "pos", "h1", "h2", "n_bytes", "length")
    rest = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("p")).alias("pos"), "h1", "h2", "n_bytes", "length")
    return heads.unionByName(rest), convs.select("conv_id", "length")


def _digests(turns: DataFrame) -> DataFrame:
    """turns with d1, d2, the digest of the prefix that ends here, and p1, p2, that of the one before."""
    mixed = turns.withColumn("own1", F.xxhash64("pos", "h1", "h2")).withColumn("own2", F.xxhash64("pos", "h2", "h1", F.lit(7)))
    mixed = mixed.select("conv_id", "pos", "length", "n_bytes", "own1", "own2", F.col("own1").alias("d1"), F.col("own2").alias("d2"), F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    mixed = _running(mixed, "conv_id", "block", ["pos"], ["d1", "d2"], xor=True)
    return mixed.select("conv_id", "pos", "length", "n_bytes", "d1", "d2", F.col("d1").bitwiseXOR(F.col("own1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("own2")).alias("p2"))


def _screened(prefixes: DataFrame, n: int, cells: int | None) -> DataFrame:
    """prefixes with `shared`: false where the sketch's estimate is one."""
    width = cells or min(MOST_CELLS, 1 << max(16, (CELLS * n).bit_length()))
    places = [F.pmod(F.xxhash64("d1", "d2", F.lit(i)), F.lit(width)) + i * width for i in range(LINES)]
    counted = prefixes.select(F.explode(F.array(*places)).alias("cell")).groupBy("cell").count().filter("count > 1")
    bits = counted.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toArrow()
    several = np.zeros(-(-LINES * width // 64), np.int64)
    several[np.asarray(bits["word"])] = np.asarray(bits["bits"])
    sent = prefixes.sparkSession.sparkContext.broadcast(several)

    @F.pandas_udf("boolean")
    def shared(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for cell in (x.to_numpy() for x in (a, b, c, d)):
            out &= (sent.value[cell >> 6] >> (cell & 63)) & 1 == 1
        return pd.Series(out)

    return prefixes.withColumn("shared", shared(*places))


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and conversation, a row for each node of a batch: its ids as text."""
    for part in parts:
        pos, d1, d2, conv = (np.asarray(part.column(c)) for c in (*NODE, "conv_id"))
        if not len(conv):
            continue
        first = np.concatenate(([0], np.flatnonzero((np.diff(pos) != 0) | (np.diff(d1) != 0) | (np.diff(d2) != 0)) + 1))
        stop = np.append(first[1:], len(conv))
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(first, stop)]
        yield pa.RecordBatch.from_arrays([pa.array(pos[first]), pa.array(d1[first]), pa.array(d2[first]), pa.array(conv[first]), pa.array(texts, pa.string())], [*NODE, "first", "ids"])


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's packs, joined by commas, in their order; one hash is open at a time."""
    node, digest = None, None
    for part in parts:
        done: list[tuple] = []
        for *at, ids in zip(*(part.column(c).to_pylist() for c in (*NODE, "ids"))):
            if at == node:
                digest.update(b"," + ids.encode())
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(ids.encode())
        yield _hashes(done)
    if node is not None:
        yield _hashes([(*node, digest.hexdigest())])


def _hashes(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) or [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """pos, d1, d2, ends_sha256: of the ids of the members that end at each node."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["d1", "d2", "pos"]
    rows = members.filter("pos = length").select(*NODE, "conv_id").repartitionByRange(n, *order, "conv_id").sortWithinPartitions(*order, "conv_id")
    packs = rows.mapInArrow(_packed, "pos long, d1 long, d2 long, first long, ids string")
    return packs.repartition(n, *NODE).sortWithinPartitions(*order, "first").mapInArrow(_hashed, "pos long, d1 long, d2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, cells: int | None = None) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos, h1, h2, n_bytes, length; convs: conv_id, length, for every conversation, also those without a
    turn. cells: counters of a line of the sketch, where not to follow from the number of turns.
    """
    prefixes = materialize(_digests(turns))
    screened = _screened(prefixes, prefixes.count(), cells)
    single = materialize(screened.filter("not shared").groupBy("conv_id").agg(F.min("pos").alias("single")))
    prefixes = prefixes.join(single, "conv_id", "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)

    root = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), "length", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "d1", "d2", "p1", "p2")])
    members = materialize(prefixes.filter("single is null or pos < single").drop("single").unionByName(root))
    stubs = prefixes.filter("pos = single").select("conv_id", "pos", "length", "p1", "p2")

    nodes = members.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("length").alias("longest"), F.max("n_bytes").alias("n_bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).withColumn("upto", F.col("saved"))
    nodes = materialize(_running(nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)), "conv_id", "block", ["pos"], ["upto"]))

    # What each conversation represents: its chain's sum, and whether it has a leaf.
    chains = nodes.groupBy("conv_id").agg(F.sum("saved").alias("chain"), F.max((F.col("longest") == F.col("pos")).cast("long")).alias("leaf"))
    chains = chains.unionByName(single.select("conv_id", F.lit(0).cast("long").alias("chain"), F.lit(1).cast("long").alias("leaf")))
    chains = chains.groupBy("conv_id").agg(F.sum("chain").alias("chain"), F.max("leaf").alias("leaf")).filter("chain > 0 or leaf > 0")
    sums = members.select("conv_id", *NODE).join(chains, "conv_id").groupBy(*NODE).agg(F.sum("chain").alias("chains"), F.sum("leaf").alias("n_leaves"))
    below = nodes.filter("pos > 0").select("pos", "p1", "p2").unionByName(stubs.select("pos", "p1", "p2"))
    children = below.groupBy((F.col("pos") - 1).alias("pos"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))

    # The node's chain above it is left out of the sum: the running sum up to the node, without the node's own.
    shared = nodes.join(sums, NODE, "left").join(children, NODE, "left").join(ends(members), NODE, "left")
    shared = shared.select(
        "conv_id", "pos", "p1", "p2", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("chains", F.lit(0)) - (F.col("upto") - F.col("saved"))).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    last = F.col("pos") == F.col("length")
    alone = [F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
             F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256")]
    hung = shared.unionByName(stubs.select("conv_id", "pos", "p1", "p2", *alone))
    parents = nodes.select((F.col("pos") + 1).alias("pos"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    hung = hung.join(parents, ["pos", "p1", "p2"], "left").withColumnRenamed("pos", "depth")
    tails = prefixes.filter("pos > single").select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), *alone)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return hung.select(*out).unionByName(tails.select(*out))
