import os
import random
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, exact and near copies, repeated rows, shared passages, an extra clashing column."""
    rng = random.Random(7)
    syllables = "the of and to in er re on an ti en th nd ha it or".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(150)
    texts = [text(rng.randrange(60, 200)) for _ in range(14)]
    near = texts[3].split(" ")
    near[30] = "changed"
    texts += [texts[0], texts[0], " ".join(near), text(40) + " " + passage, passage + "\n" + text(50), text(30) + " " + passage + " " + text(9), None, "", " \n\t ", "one", "two words here", "Elle " * 400, "a b c a b c a b c d", "é日本 ß 'tis it's we'll  ", "x" * 3000, "!!! $$$ 123", text(3000)]
    rows = [(i, t, "en" if i % 3 else None, ["s1", "s2", None][i % 3], len(t or ""), "clash") for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[5], None, "s1", 0, "x")]  # a repeated row; a row without an id
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size string").repartition(3).cache()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
