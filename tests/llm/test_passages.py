"""Passages that documents share, against brute force, and op8 as it is registered: its contract's columns and these."""

import random
import re

import pytest

import __spark_entry__
from tessera.llm import passages, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """Words covered by runs of length words that another id holds, by id."""
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    holders: dict[tuple, set] = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            holders.setdefault(tuple(w[p : p + length]), set()).add(i)
    out = {}
    for i, w in words:
        cover = [False] * len(w)
        for p in range(len(w) - length + 1):
            if len(holders[tuple(w[p : p + length])]) > 1:
                cover[p : p + length] = [True] * length
        if any(cover):
            out[i] = sum(cover)
    return out


@pytest.mark.parametrize("length", [51, 9, 3])
def test_shared_words_equal_brute_force(docs, length):
    got = {r.doc_id: r.n_shared_words for r in passages.shared(docs.select("doc_id", "text"), length).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], length)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (None, text), (1, "other " * 70), (1, text[:150]), (-(1 << 62), None), (2, "é" + text.replace(" ", "\n\t"))]
    got = {r.doc_id: r.n_shared_words for r in passages.shared(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {None: 79, 2: 79}  # the first word differs
    assert passages.shared(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_registered_op8_catches_passages_under_400_bytes(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(str(rng.randrange(10**4)) for _ in range(n))
    passage = text(55)
    assert len(passage) < 400
    long = text(120)
    rows = [(0, text(90) + " " + passage), (1, passage + "\n" + text(60)), (2, text(150)), (3, None), (4, long), (5, long), (6, text(40) + " " + passage[: len(passage) // 2])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in __spark_entry__.queries()["op8_repeats"](spark, str(tmp_path)).collect()}
    contract = {r.doc_id: r for r in queries.queries()["op8_repeats"](spark, str(tmp_path)).collect()}
    assert {i: tuple(r)[:5] for i, r in got.items()} == {i: tuple(r) for i, r in contract.items()}
    assert {i: (r.n_shared_words, r.shares_passage) for i, r in got.items()} == {0: (55, True), 1: (55, True), 2: (0, False), 3: (0, False), 4: (120, True), 5: (120, True), 6: (0, False)}
    assert got[0].n_removed == got[1].n_removed == 0 and got[4].n_removed == len(long)
