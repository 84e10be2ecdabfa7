"""Exact search, hard negatives and the prefix trie against brute force, with nulls, ties, repeated rows and odd lengths."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives, queries, topk, trie, vectors

ROWS = "vec_id bigint, embedding array<float>, label int, id string, v string, row string"


@pytest.fixture(scope="module")
def rows():
    """Unequal lengths, null and non-finite components, null ids and labels, repeated rows, equal vectors, long and short ones."""
    rng = random.Random(5)
    vector = lambda n, s=1.0: [float(np.float32(rng.gauss(0, s))) for _ in range(n)]
    out = [(i, vector(6, 1 + i % 3), i % 4) for i in range(420)]
    out += [(1000 + i, out[7][1], i % 3) for i in range(40)]  # ties
    out += [out[0], out[100], out[100], out[150], (100, vector(6), 1)]  # repeated rows, an id with two vectors
    out += [(None, vector(6, 4), 2), (None, vector(6, 4), None), (500, None, 1), (600, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (700, [math.nan] * 6, 1), (800, [math.inf] * 6, 2), (900, [], 3), (1200, vector(3, 5), None), (1300, vector(8, 2), 0), (1400, [0.0] * 6, 1)]
    return [(*r, "x", "y", "z") for r in out]


def prepared(rows, scale):
    out = []
    for vec_id, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((vec_id, [math.floor(scale * float(x)) for x in v], label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def by_score(found):
    return sorted(found, key=lambda c: (-c[0], c[1] is None, c[1] or 0, c[2]))


def brute_top(rows, k, scale=1024):
    rows, out = prepared(rows, scale), []
    for i, (q, v, _) in enumerate(rows):
        if q is not None and q % 100 == 0:
            found = by_score([(dot(v, w), c, j) for j, (c, w, _) in enumerate(rows) if j != i])[:k]
            out += [(q, n + 1, c, s) for n, (s, c, _) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile, dense, query_bytes", [((1024, 2048), 0.25, 16 << 20), ((3, 16), 2.0, 256), ((4, 8), -1.0, 1 << 20)])
def test_top_k_equals_brute_force(spark, rows, monkeypatch, tile, dense, query_bytes):
    """In one or several batches of queries, by pairs or by whole tiles."""
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "DENSE", dense)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted((tuple(r) for r in topk.search(df, F.col("id") % 100 == 0, k=7, query_bytes=query_bytes).collect()), key=str)
    assert got == brute_top(rows, 7)


def test_bounds_skip_pairs_and_lose_none():
    """On vectors of falling length the bounds leave few exact products, and the lists are right."""
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(3000, 32)) * np.geomspace(900, 3, 32) * np.linspace(3, 0.2, 3000)[:, None]).astype(np.int64)
    import pyarrow as pa

    table = pa.table({"v": pa.array(v[::300].tolist(), pa.list_(pa.int64())), "row": np.arange(0, 3000, 300), "id": np.arange(0, 3000, 300)})
    rotation, counts = topk._rotation(v[:500])
    q = topk._Queries(table, 32, 5, v[:500], np.arange(500), rotation, counts)
    heaps, exact = vectors.Heaps(10, 5), []
    counted = heaps.add
    heaps.add = lambda *a: (exact.append(len(a[0])), counted(*a))
    for at in range(0, 3000, 100):
        q.block(heaps, v[at : at + 100], np.arange(at, at + 100), np.zeros(100, bool), np.arange(at, at + 100))
    scores = v[::300] @ v.T
    scores[np.arange(10), np.arange(0, 3000, 300)] = -(2**62)
    for h in range(10):
        want = np.lexsort((np.arange(3000), -scores[h]))[:5]
        assert heaps.entries[2][heaps.entries[0] == h].tolist() == want.tolist()
    assert sum(exact) < 0.2 * 10 * 3000


def test_search_of_nothing(spark):
    nothing = spark.createDataFrame([], ROWS)
    assert topk.search(nothing, F.col("id") % 100 == 0).collect() == []
    assert negatives.mine(nothing, F.col("id") % 50 == 0, F.col("label")).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 1, "", "", "")], ROWS)
    assert topk.search(alone, F.col("id") % 100 == 0).collect() == [] and negatives.mine(alone, F.col("id") % 50 == 0, F.col("label")).collect() == []


def test_components_saturate(spark):
    """Beyond 2**31 / sqrt(length) a component is cut, so no score leaves 64 bits."""
    df = spark.createDataFrame([(0, [1e30, 1e30], 1, "", "", ""), (1, [3e38, -3e38], 1, "", "", ""), (2, [1e30, 1e30], 1, "", "", "")], ROWS)
    most = math.floor(2**31 / math.sqrt(2))
    assert [(r.vec_id, r.score) for r in topk.search(df, F.col("id") == 0).orderBy("rank").collect()] == [(2, 2 * most**2), (1, 0)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (33, 64, 17), (64, 64, 64), (100, 3, 50)])
@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_strassen_is_exact(shape, leaf):
    rng = np.random.default_rng(3)
    m, d, n = shape
    for most in (300, 2**28):
        a, b = rng.integers(-most, most, (m, d)), rng.integers(-most, most, (d, n))
        assert (negatives.strassen(a, b, leaf) == (a.astype(object) @ b.astype(object))).all()


def brute_negatives(rows, n_pos=5, n_neg=3):
    rows = [(i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in prepared(rows, 256) if lab is not None]
    out = []
    for a, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(dot(v, w), c, j, lab) for j, (c, w, lab) in enumerate(rows) if j != a]
        for p, positive, _, _ in by_score([x for x in scored if x[3] == label])[:n_pos]:
            fits = by_score([x for x in scored if x[3] != label and 50 * p <= 100 * x[0] <= 95 * p])[:n_neg]
            out += [(anchor, positive, k + 1, c, p, s) for k, (s, c, _, _) in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile, leaf, anchor_bytes", [((1024, 2048), 32, 8 << 20), ((3, 16), 2, 200)])
def test_hard_negatives_equal_brute_force(spark, rows, monkeypatch, tile, leaf, anchor_bytes):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives.strassen, "__defaults__", (leaf,))
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(df, F.col("id") % 50 == 0, label, anchor_bytes=anchor_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows)


def test_percent_without_overflow():
    x = np.array([2**60, -(2**60), 7, -7, 0, 99, -101])
    assert negatives._percent(x, 95).tolist() == [int(v) * 95 // 100 for v in x]


# the trie ------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, length string, pos string"


@pytest.fixture(scope="module")
def talks():
    """Shared prefixes, copies, a conversation inside another, null turns, roles, texts and ids, a very long one, repeated rows."""
    rng = random.Random(11)
    words = ["yes", "no", "é日本", "", None, "why " * 3000]
    out = []
    for c in range(60):
        out += [(c, t, ["user", None][t % 2] if c % 9 else "user", rng.choice(words[: 2 + c % 5])) for t in range(rng.randrange(0, 7))]
    out += [(c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(5)]
    out += [(c, t, "user", f"copy {t}") for c in range(140, 145) for t in range(3)]
    out += [(205, None if t == 3 else t, "user", f"t{t}") for t in range(6)] + [(206, t, "user", "t0") for t in (4, 4, 4)]
    out += [(207, t * 3, "user", f"long {t % 7}") for t in range(2500)] + [(208, t, "user", f"long {t % 7}") for t in range(2500)]
    out += [(-7, 1, "user", "below"), (-5, 1, "user", "base"), (None, 1, "user", "nobody"), (None, None, None, None)]
    return [(*r, "x", "y") for r in out]


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    code, paths = {}, {}  # a number for each (parent, turn)
    for c, x in built.items():
        paths[c] = [0]
        for t in x:
            paths[c].append(code.setdefault((paths[c][-1], t), len(code) + 1))
    members, depth, parent, last, ends, kids = collections.defaultdict(list), {0: 0}, {0: None}, {0: ""}, collections.defaultdict(list), collections.defaultdict(list)
    for (p, t), n in code.items():
        depth[n], parent[n], last[n] = depth[p] + 1, p, t[1]
        kids[p].append(n)
    for c, path in paths.items():
        for n in path:
            members[n].append(c)
        ends[path[-1]].append(c)
    leaves, saved = {}, {}
    for n in sorted(members, key=lambda n: -depth[n]):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = (len(members[n]) - 1) * len(last[n].encode()) + sum(saved[k] for k in kids[n])
    return sorted((min(members[n]), depth[n], None if n == 0 else min(members[parent[n]]), len(members[n]), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n in members)


@pytest.mark.parametrize("cells", [None, 4, 64])
def test_trie_equals_brute_force(spark, talks, cells):
    """With a sketch that fits, one that proves nothing, and one between; in a table without ties of different turns."""
    df = spark.createDataFrame([r for r in talks], TURNS).repartition(3)
    got = trie.prefix_trie(*trie.rebuilt(trie.ordered(df)), cells=cells)
    assert sorted(tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()) == brute_trie(talks)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(*trie.rebuilt(trie.ordered(df))).collect() == []


def test_trie_of_turnless_conversations(spark):
    """Conversations whose own turns are all within the part that they would take from an absent base end at the root."""
    ids = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:12]
    df = spark.createDataFrame([(c, 0, "user", "one", "", "") for c in ids], TURNS)
    (root,) = trie.prefix_trie(*trie.rebuilt(trie.ordered(df))).collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_children, root.n_leaves) == (min(ids), 0, len(ids), 0, 1)
    assert root.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def test_registered_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op11_top_k", "op12_prefix_trie", "op13_hard_negatives"):
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        want = con.execute(queries.oracle_sql()[name])
        assert [c[0] for c in want.description] == got.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
