"""Quality rules: a table of thresholds compiled into one Spark projection.

All measures are built-in functions over the text, its words and its lines: no user function, no shuffle.
Null and empty texts have no word and fail the base rule. Repeated rows and ties don't matter, as rows are judged
alone. Very long texts are judged whole, like others; an empty table gives an empty one. Extra columns pass through;
measures overwrite columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK

#: Frequent function words of the languages met (English, German, French, Spanish).
STOP_WORDS = (
    "the be to of and that have with in is a "
    "der die das und von zu den mit ist ein "
    "le la les de et des un une en que "
    "el los las del y por con se no es"
).split()

#: (rule, measure, lowest, highest); None: no bound on that side.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word_count", "n_words", 50, 1_000_000),
    ("mean_word_length", "mean_word_length", 2.0, 15.0),
    ("symbol_ratio", "symbol_ratio", None, 0.10),
    ("stop_word_ratio", "stop_word_ratio", 0.02, None),
    ("dup_line_ratio", "dup_line_ratio", None, 0.30),
    ("repeat_word_ratio", "repeat_word_ratio", None, 0.50),
)

def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words that lie in a 3-word window found twice or more in the text.

    Each window becomes its 64-bit hash and its position. Sorted, equal windows are neighbours; a window is repeated if
    it agrees with the one before or after. The repeated positions, sorted, cover min(3, gap) words each. Every array
    is a column of its own, as a lambda would compute it anew for each element.
    """
    n, words = F.size("_words"), F.col("_words")
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    at = F.sequence(F.lit(0), n - 3)
    df = df.withColumn("_windows", F.when(n >= 4, F.sort_array(F.transform(at, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))))
    srt = F.col("_windows")
    hit = F.filter(srt, lambda x, i: x["h"].eqNullSafe(F.get(srt, i - 1)["h"]) | x["h"].eqNullSafe(F.get(srt, i + 1)["h"]))
    df = df.withColumn("_at", F.coalesce(F.sort_array(F.transform(hit, lambda x: x["i"])), F.array().cast("array<int>")))
    pos = F.col("_at")
    gaps = F.transform(pos, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)).drop("_windows", "_at")


def measures(docs: DataFrame) -> DataFrame:
    """docs with the counts and ratios that the rules refer to."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = _with_repeats(docs.withColumn("_words", _words(text))).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
    }).drop("_words", "_lines")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns({
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    })


def verdict(rules=RULES) -> Column:
    """True if every rule of the table holds."""
    ok = F.lit(True)
    for _, measure, low, high in rules:
        if low is not None:
            ok = ok & (F.col(measure) >= low)
        if high is not None:
            ok = ok & (F.col(measure) <= high)
    return ok


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with measures, base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
