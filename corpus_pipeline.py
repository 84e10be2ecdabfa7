"""The corpus pipeline: language ID, near-dedup, removal of repeats, mixing, encoding; each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. Nulls, empty texts, repeated rows and extra columns are treated as the
operators' docstrings say: rows without a letter go at the first stage, repeated rows at the second; extra columns stay.
Very long texts go through whole. Ties are settled as in the operators: the least id of a class stays, equal languages go
to the first by code point, equal ranks follow by id. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, neardup, repeats
from tessera.llm.common import id_remainder, materialize

#: Bytes from which a repeated string is cut. The stage has to catch passages of over 50 words; with five letters and a
#: blank a word these begin at about 300 bytes, and the string must fit inside. (op8's own contract says 400 bytes.)
PASSAGE = 256

#: Whole pipeline in one SQL statement: suffix structures, lattice scans and merges aren't SQL.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; `und` goes. lang becomes the prediction."""
    filters = langid.fit(docs.select("doc_id", "text", "lang").filter(id_remainder(F.col("doc_id"), 5) != 0))
    kept = langid.predict(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], "text"), filters, keep_text=True)
    kept = kept.filter(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select(*[F.col("lang_pred" if c == "lang" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id."""
    return neardup.distinct(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; documents of which nothing but blanks is left go. n_chars follows the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], "doc_id", "text")
    cut = repeats.remove(held, PASSAGE, columns=names, as_text=True).filter(F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return cut.select(*[fresh.get(f.name, F.col(n)).cast(f.dataType).alias(f.name) for f, n in zip(docs.schema.fields, names, strict=True)])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its copies."""
    return mixing.repeated(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the ids of every text."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
