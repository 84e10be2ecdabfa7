"""The registered queries of the document operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, lm, mixing, neardup, negatives, passages, quality, repeats, topk, toxicity, trie
from .common import id_remainder, materialize, read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, then=bpe.digests(path), then_schema=bpe.DIGESTS)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), columns=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(trie.ordered(read(spark, sf_dir, "conversations")))
    return trie.prefix_trie(*trie.rebuilt(turns))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def repeats_and_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_repeats, and the words of passages of over 50 words that another document holds too, which 400 bytes often don't reach."""
    shared = passages.shared(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc_id", "_doc_id")
    found = op8_repeats(spark, sf_dir)
    n = F.coalesce("n_shared_words", F.lit(0).cast("long"))
    return found.join(shared, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left").select(*found.columns, n.alias("n_shared_words"), (n > 0).alias("shares_passage"))


def registered() -> dict:
    """What the driver runs: the queries, op8 with its further columns."""
    return queries() | {"op8_repeats": repeats_and_passages}


_OP7 = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(generate_series(1, len(ws) - 2)) u(i)),
dup AS (SELECT doc_id, a, b, c FROM tri GROUP BY ALL HAVING count(*) > 1),
pos AS (SELECT DISTINCT tri.doc_id, i + k AS p FROM tri JOIN dup USING (doc_id, a, b, c), generate_series(0, 2) g(k)),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM pos GROUP BY 1),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, len(list_filter(ws, lambda x: lower(x) IN (STOPS))) AS n_stop, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
k AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 50 AND 1000000 AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / word_chars <= 0.10 AND n_stop / n_words >= 0.02 AND n_dup_lines / len(ls) <= 0.30 AND n_repeat_words / n_words <= 0.50 AS kept FROM k"""


_VECTORS = """r AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS BIGINT[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_DOT = "coalesce(list_sum(list_transform(generate_series(1, least(len({a}), len({b}))), lambda i: {a}[i] * {b}[i])), 0)"

_OP11 = f"""WITH {_VECTORS.format(scale=1024)},
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST({_DOT.format(a="q.v", b="c.v")} AS BIGINT) AS score FROM r q JOIN r c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""

#: h by the definition of CRC-32: the reflected polynomial, bit by bit. Members of all prefixes, then subtrees by membership.
_OP12 = """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY i) AS xs FROM t GROUP BY 1),
steps AS (SELECT conv_id, xs, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS st FROM o),
hs AS (SELECT conv_id, xs, xor(list_reduce(list_prepend(4294967295::BIGINT, st), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 9 AS h FROM steps),
b AS (SELECT a.conv_id, list_concat(coalesce(list_slice(z.xs, 1, a.h), []), list_slice(a.xs, a.h + 1, len(a.xs))) AS xs FROM hs a LEFT JOIN o z ON z.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT conv_id AS c, d, len(xs) AS n, list_slice(xs, 1, d) AS k, coalesce(strlen(xs[d].text), 0) AS bytes, CASE WHEN d > 0 THEN list_slice(xs, 1, d - 1) END AS pk FROM b, unnest(generate_series(0, len(xs))) u(d)),
g AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, max(n) AS longest, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256, row_number() OVER () AS node FROM m GROUP BY d, k),
p AS (SELECT m.c, g.d, g.node, g.longest = g.d AS leaf, (g.n_convs - 1) * g.bytes AS saved FROM m JOIN g USING (d, k)),
sub AS (SELECT DISTINCT a.node AS top, z.node, z.leaf, z.saved FROM p a JOIN p z ON a.c = z.c AND z.d >= a.d),
s AS (SELECT top AS node, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM sub GROUP BY 1),
ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, f.conv_id AS parent_conv_id, g.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM g JOIN s USING (node) LEFT JOIN ch ON ch.d = g.d AND ch.k = g.k LEFT JOIN g f ON f.d = g.d - 1 AND f.k = g.pk"""

_OP13 = f"""WITH {_VECTORS.format(scale=256)},
r2 AS (SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM r WHERE label IS NOT NULL),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, c.r, CAST({_DOT.format(a="a.v", b="c.v")} AS BIGINT) AS score FROM r2 a JOIN r2 c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, r) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.nth <= 5)
SELECT * FROM n WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """Rules, searches and the trie are SQL; the other operators hash, scan or learn, and are tested against brute force."""
    rules = _OP7.replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS))))
    return {"op7_quality_rules": rules, "op11_top_k": _OP11, "op12_prefix_trie": _OP12, "op13_hard_negatives": _OP13}
