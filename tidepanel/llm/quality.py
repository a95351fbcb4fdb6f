"""Quality rules: one projection compiled from a threshold table (native functions only).

Defined results: null or empty text has no words, fails the base rule and is not kept;
a text without lines has line ratios 0; repeated documents get equal rows; an empty table
gives no rows; only the id and text columns are read. Three-word windows are compared by
their 64-bit hash within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import text as T

SYMBOLS = r"[#*$%&|<>]"

# Frequent function words (English, German, French, Spanish).
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "have", "he", "in", "is",
    "it", "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "were", "which", "with", "you",
    "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "er", "für", "im", "ist",
    "mit", "nicht", "sich", "sie", "und", "von", "zu",
    "au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas",
    "pour", "que", "qui", "sur", "un", "une",
    "con", "del", "el", "es", "esta", "la", "las", "lo", "los", "no", "o", "para", "por", "se", "su", "una", "y",
]

# Threshold table: metric, lowest and highest value kept (None: open).
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def repeated_window_words(df: DataFrame, words: str = "words", out: str = "n_repeat_words") -> DataFrame:
    """Adds the number of words inside three-word windows that occur at least twice.

    Texts whose windows are all distinct (one hash set per text) stop there; the others
    sort their (hash, place) pairs, so the cost is n log n even for very long texts.
    """
    w = F.col(words)
    grams = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    grams = F.when(F.size(w) >= 3, F.slice(grams, F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))).otherwise(T.empty_longs())
    df = T.fixed(df, _grams=grams)
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = T.fixed(df, _pairs=F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs).otherwise(none))
    p = F.col("_pairs")
    twice = F.filter(p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]))
    df = T.fixed(df, _starts=F.array_sort(F.transform(twice, lambda x: x["i"])))
    s = F.col("_starts")
    own = F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1), x + 3) - x))
    return df.withColumn(out, F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_grams", "_pairs", "_starts")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of every document."""
    df = T.documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    wordy = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = T.fixed(df, words=T.space_words(F.col("text")), lines=wordy)
    df = repeated_window_words(df)
    spoken = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    df = df.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", T.WHITE_SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.size("lines").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(spoken))).alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))).alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipses"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipses"), F.col("n_lines")).alias("ellipsis_line_ratio"))


def compile_rules(rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    """One boolean column that is true where every threshold of the table holds."""
    parts = [F.col(m) >= lo for m, lo, _ in rules if lo is not None] + [F.col(m) <= hi for m, _, hi in rules if hi is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judge(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Measures of every document with ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (measure(docs, id_col, text_col).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)))
