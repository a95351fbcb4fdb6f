"""Column helpers shared by the text operators (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import ensure_checkpoint_dir, ship_package

# Separators of the two word definitions. Alphanumeric words are what remains after
# ASCII A-Z are lower-cased; every non-ASCII character counts as part of a word.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE_SPACE = r"[\x20\x09-\x0D]+"


ARROW_ROWS = 1000  # texts in one Arrow batch: a few MB, whatever the executor's cores


def prepare_session(spark) -> None:
    """Shared checkpoint folder, shipped package, and Arrow batches sized for texts.

    Spark's default batch of 10,000 rows is meant for narrow rows; a setting of the
    user's own is left alone.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other characters (É, İ, the Kelvin sign) stay as they are.

    Pure ASCII texts (as many code points as bytes) take the JVM's fast ``lower``.
    """
    return (F.when(F.length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def alnum_words(text: Column) -> Column:
    """Lower-cased alphanumeric words of a text, in order; null text gives no words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_ALNUM), "")


def space_words(text: Column) -> Column:
    """White-space separated words of a text, in order; null text gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def empty_longs() -> Column:
    return F.array().cast("array<bigint>")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of any table, whatever its other columns are called."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """64-bit key of a text; with the document id it names a row up to exact repeats."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


BROADCAST_KEYS = 1_000_000  # rows (two numbers each) of a verdict that is broadcast to the documents


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _by_keys(docs: DataFrame, keys: DataFrame, null_id: int, how: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) joined with a stored table of ``doc_id, key``."""
    bad = keys.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key"))
    if bad.count() <= BROADCAST_KEYS:
        bad = F.broadcast(bad)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id))
    return docs.join(bad, (own == bad["_bad_id"]) & (text_key(F.col("text")) == bad["_bad_key"]), how)


def without_keys(docs: DataFrame, keys: DataFrame, null_id: int) -> DataFrame:
    """Rows whose id (``null_id`` for null) and text key are not listed; all columns are kept.

    The list is counted and broadcast if it is small, so texts stay where they are; a
    longer list is joined by a shuffle.
    """
    return _by_keys(docs, keys, null_id, "left_anti")


def with_keys(docs: DataFrame, keys: DataFrame, null_id: int) -> DataFrame:
    """Rows whose id and text key are listed (see ``without_keys``)."""
    return _by_keys(docs, keys, null_id, "left_semi")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds computed columns that are evaluated exactly once per row.

    A plain projection may be copied by the optimizer into every place that uses it: a
    filter pushed below it, or the body of a lambda, which would then run it once per
    array element. The output of a generator is not copied, so the values pass through
    a one-element ``explode``.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df
