"""The document operators against brute force, libraries, round trips and held-out rows, on small tables with all odd cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, fingerprints, langid, lm, mixing, neardup, quality, repeats, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def empty(docs):
    return docs.limit(0)


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def shingles(text):
    w = WORDS.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sequence(text, known):
    """A text's five-word shingles in order, numbered by `known`."""
    w = WORDS.findall(text)
    return np.array([known.setdefault(tuple(w[i : i + 5]), len(known)) for i in range(max(1, len(w) - 4))] if w else [], np.uint64)


# 1 -------------------------------------------------------------------------------------------------------------


def test_fingerprints_estimate_resemblance(spark, docs):
    base = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.compare_edits(base).collect()}
    order = sorted(rows_of(base))
    errors = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, value in ((edited, got[i].near_edited), (nxt, got[i].near_next)):
            a, b = shingles(t), shingles(other)
            errors.append(abs(value - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.16 and sum(errors) / len(errors) < 0.03
    by_text = collections.defaultdict(set)
    for i, t in order:
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert got[next(i for i, t in order if t == "")].fingerprint == ""


def test_fingerprints_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    df = spark.createDataFrame([(i * i - 50, f"text number {i} " * 8) for i in range(100)], "doc_id bigint, text string").repartition(5)
    order = sorted(rows_of(df))
    nxt = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    got = fingerprints.with_next_text(df).filter("not edge").collect()
    assert len(got) == 100 and all(r.next_text == nxt[r.doc_id] for r in got)


def test_fingerprints_of_nothing_and_ties(spark, docs):
    assert fingerprints.compare_edits(empty(docs)).count() == 0
    assert fingerprints.compare_edits(docs).count() == docs.count()


# 2, 3 ----------------------------------------------------------------------------------------------------------


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_encoding_equals_the_library_and_round_trips(docs):
    enc = library()
    encoded = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert encoded.columns == [*docs.columns, "ids", "token_ends", "decoded"]
    for r in encoded.collect():
        t = r.text or ""
        assert r.ids == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode()
        assert (r.token_ends or [0])[-1] == len(t.encode())
    assert bpe.encode(empty(docs), RANKS).count() == 0


def test_pre_tokens_on_random_texts():
    rng, enc = random.Random(3), library()
    alphabet = "ab'stremvld  \n\t 　.,!1 2é日ßⅧ're've'll\x00\U0001f600\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)] + ["", "'s" * 40, " " * 500, "z" * 4000]
    ids, at = bpe.Encoder(RANKS).encode(texts)
    assert all(ids[at[i] : at[i + 1]].tolist() == enc.encode_ordinary(t) for i, t in enumerate(texts))


def test_token_counts_equal_the_library(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = docs.unionByName(spark.createDataFrame([(900, "a<|endoftext|> b<|endoftext|>"), (901, "<|endoftext|>")], "doc_id bigint, text string"), allowMissingColumns=True)
    want = [(i, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in rows_of(more)]
    same([tuple(r) for r in bpe.count_tokens(more, RANKS).select("doc_id", "n_bytes", "n_tokens").collect()], want)
    assert bpe.count_tokens(empty(docs), RANKS).count() == 0


# 4, 9 ----------------------------------------------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bdfglm" for b in "aeiou"]
    rows = []
    for i in range(600):
        text = [rng.choice(words) + rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            text[rng.randrange(40)] = rng.choice(["stupidhead", "vilescum"])
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_on_held_out_rows(spark, docs):
    df = labelled(spark)
    model = toxicity.fit(df, df.filter("doc_id % 4 <> 0").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(r.doc_id, r.toxic) for r in df.filter("doc_id % 4 = 0").collect()]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert toxicity.score(empty(docs), toxicity.fit(empty(docs), none)).count() == 0


def languages(spark):
    rng = random.Random(2)
    alphabets = {"aa": "the of and ing er".split(), "bb": "der und sch ein ung".split(), "cc": "ción que los ado ente".split()}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), k) for i, (k, a) in enumerate(itertools.islice(itertools.cycle(alphabets.items()), 450))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_on_held_out_rows(spark):
    df = languages(spark)
    found = langid.predict(df, langid.fit(df.filter("doc_id % 5 <> 0")))
    held = found.filter("doc_id % 5 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_rows(spark, docs):
    filters = langid.fit(languages(spark))
    got = langid.predict(docs, filters, keep_text=True).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.filter("lang = 'zz'"))).collect()} == {"und"}
    assert langid.predict(empty(docs), filters).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    vocab = lm.vocabulary(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {model.id_to_piece(i): i for i in range(vocab.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}

    def total(s):
        if not s:
            return 1.0
        out = 0.0
        for n in range(1, min(16, len(s)) + 1):
            if s[:n] in ids:
                out += math.exp(vocab.first[ids[s[:n]]]) * total(s[n:])
            elif n == 1:
                out += math.exp(vocab.first[vocab.bytes[list(s[0].encode())]].sum()) * total(s[1:])
        return out

    words = ["the", "thandth", "é", "日x", "\U0001f600", "!!"]
    got, _ = lm.lattice(vocab, vocab.first, words)
    assert all(abs(g - math.log(total(lm.MARK + w))) < 1e-9 for g, w in zip(got, words, strict=True))


def test_scores_and_base(docs):
    got = lm.score(docs, PIECES, rounds=1).collect()
    rows = rows_of(docs)
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    counts, n = collections.Counter(), 0
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            counts.update(WORDS.findall(t.translate(lower)))
            counts["\0end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*WORDS.findall(t.translate(lower)), "\0end"]
        want.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
    train = collections.Counter({w: c for w, c in counts.items() if w != "\0end"})
    vocab = lm.vocabulary(PIECES)
    _, uses = lm.lattice(vocab, np.append(vocab.first, -np.inf), list(train), np.array(list(train.values()), float))
    logp = lm._maximized(vocab, uses, counts["\0end"])
    scores = [(i, round((sum(lm.lattice(vocab, logp, WORDS.findall(t.translate(lower)))[0]) + logp[-1]) / math.log(10), 6)) for i, t in rows]
    same([(r.doc_id, round(r.score, 6)) for r in got], scores)
    assert lm.score(empty(docs), PIECES).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------


def test_classes_are_components_of_near_texts(docs):
    rows = rows_of(docs)
    known: dict = {}
    seq = [sequence(t, known) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][1] == rows[b][1] or neardup.alignment(seq[a], seq[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    want = [(d, min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]
    same([(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()], want)
    kept = neardup.distinct(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert neardup.classes(empty(docs)).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))])
        b = np.array([x for x in a if rng.random() > 0.1] or [1])
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        s = t[-1][-1] / (len(a) + len(b) - t[-1][-1])
        assert abs(neardup.alignment(a, b, 0.6) - (s if s >= 0.6 else 0.0)) < 1e-12


def test_banded_distance_equals_the_diagonal_one():
    rng = random.Random(12)
    for _ in range(300):
        k = rng.choice([2, 5, 60])
        x = [rng.randrange(k) for _ in range(rng.randrange(1, 60))]
        y = [v for v in x if rng.random() > 0.2] + [rng.randrange(k) for _ in range(rng.randrange(8))]
        d = neardup._distance(x, y, len(x) + len(y))
        for most in (d, d + 5, d - 1):
            if y and most >= 0:
                assert neardup._banded(x, y, most, block=rng.choice([1, 7, 64])) == (d if d <= most else None)


def test_common_passage_hides_no_near_copies(spark):
    """A sketch that hundreds of unlike texts share: pairs of near copies among them are still found, and no others."""
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = [f"o{i}x{k}" for k in range(60)]
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(own[:30] + ["new"] + own[31:] + passage))] if i % 10 == 0 else [(2 * i, " ".join(own + passage))]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_very_long_near_copies(spark):
    words = [f"w{i % 7001}x{i % 31}" for i in range(60_000)]
    changed = [f"c{i}" if i % 50 == 0 and i < 50_000 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "short text of six words here")]
    known: dict = {}
    near = neardup.alignment(sequence(rows[0][1], known), sequence(rows[1][1], known))
    assert abs(near - 55_000 / 64_992) < 1e-9  # 1,000 words are changed: the first is in one shingle, the others in five
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1 :])) for i, k in enumerate(random.Random(5).choices(range(300), k=150))]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_copies_near_their_base_only(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 251):
        words = list(base)
        for k in rng.sample(range(200), 3):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    known: dict = {}
    seq = [sequence(t, known) for _, t in rows]
    assert all(neardup.alignment(seq[0], s) >= 0.8 for s in seq)
    got = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    raw = [t.encode() for _, t in rows]
    held = neardup.sketches(*neardup.shingle_hashes(*neardup.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (held[a] == held[b]).any() and neardup.alignment(seq[a], seq[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in range(len(rows))}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a bigint, b bigint")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50


# 7 -------------------------------------------------------------------------------------------------------------


def test_quality_measures(docs):
    got = quality.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r.text or ""
        w = WORDS.findall(t)
        where = collections.defaultdict(list)
        for i in range(len(w) - 2):
            where[tuple(w[i : i + 3])].append(i)
        covered = {p + k for v in where.values() if len(v) > 1 for p in v for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty(docs)).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------


def removed(rows, length):
    counts = collections.Counter(b[p : p + length] for b in rows for p in range(len(b) - length + 1))
    out = []
    for b in rows:
        cover = [False] * len(b)
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                cover[p : p + length] = [True] * length
        out.append((len(b), bytes(c for c, x in zip(b, cover, strict=True) if not x)))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_are_removed_exactly(docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", hot)  # 1: every anchor by aggregation
    want = removed([t.encode() for _, t in rows_of(docs)], 400)
    got = repeats.remove(docs.select("doc_id", "text")).collect()
    same([(r.n_bytes, bytes(r.kept)) for r in got], want)
    assert repeats.remove(empty(docs).select("doc_id", "text")).count() == 0


def test_columns_named_like_results_give_way(docs):
    clash = docs.select("doc_id", "text", F.lit("x").alias("n_bytes"), F.lit("x").alias("Spans"), F.lit("x").alias("kept"), F.lit("y").alias("c0"))
    got = repeats.remove(clash)
    assert got.columns == ["doc_id", "c0", "n_bytes", "spans", "kept"]
    assert got.select("c0", "n_bytes", "spans", "kept").filter("c0 = 'y' and n_bytes >= 0").count() == docs.count()


def test_index_marks_repeats_in_repetitive_texts():
    rng = random.Random(6)
    for _ in range(25):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randrange(60, 160)))
        texts = []
        for _ in range(5):
            x = bytearray(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = rng.choice(b"abc")
            texts.append(bytes(x)[rng.randrange(9) :])
        counts = collections.Counter(t[p : p + 40] for t in texts for p in range(len(t) - 39))
        got = repeats.marked(texts, np.arange(5), np.zeros(5, np.int64), 40)
        assert [g.tolist() for g in got] == [[p for p in range(len(t) - 39) if counts[t[p : p + 40]] > 1] for t in texts]


# 10 ------------------------------------------------------------------------------------------------------------


def test_targets_share_all_words_by_weight(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 10), (None, 300), ("c", 0)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got["b"] == 30 and got["c"] == 0 and abs(sum(got.values()) - 410) < 1e-6 and abs(got["a"] - got[None]) < 1e-6


def test_mix_meets_targets_and_repeats_itself(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", None])) for i in range(3000)], "doc_id bigint, text string, source string")
    got = mixing.mix(df, columns=["doc_id", "source"]).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    same(got, mixing.mix(df.repartition(7), columns=["doc_id", "source"]).collect())


def test_mix_of_odd_rows(docs):
    got = mixing.mix(docs.select("doc_id", "source", "text"), columns=["doc_id"]).collect()
    same([(r.doc_id, r.size) for r in got], [(i, len(WORDS.findall(t))) for i, t in rows_of(docs)])
    assert mixing.mix(empty(docs).select("doc_id", "source", "text"), columns=["doc_id"]).count() == 0
    again = mixing.repeated(docs)
    assert again.columns == docs.columns


# The pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("size").write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    n = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.drop("size").columns, name
        if name != "mixing":
            assert now.count() <= n
            n = now.count()
    direct = corpus_pipeline.run(spark, str(tmp_path))
    enc = library()
    last = {r.doc_id: r.text for r in now.collect()}
    rows = direct.collect()
    assert rows and all(r.ids == enc.encode_ordinary(last[r.doc_id]) for r in rows)
