"""Chat formatting: keep maximal conversations of cumulative snapshots, then render them.

A log often holds a conversation again after every turn. Each turn gets a hash of its
place, role and text; the XOR of the hashes up to a turn (two independent 64-bit hashes)
identifies the prefix ending there. A conversation whose whole hash equals a proper
prefix of another one is dropped by an anti-join; of equal conversations the smallest id
stays. The rest is rendered in segments of at most ``SEGMENT`` turns, so that no
conversation, however long, is gathered into one value.

Places and prefix hashes come from narrow rows (ids, turn number, two hashes), stored once.
They are sorted by (conversation, turn, hashes) into range partitions; counts and hashes are
summed per (conversation, partition), and the running values over that far smaller table
are added back. The sort key tells all rows apart, so a hot conversation is split over
partitions whatever its turn numbers, null ones too. Texts meet the places of maximal
conversations only, in one join, and are then gathered by segment. Native functions only.

Defined results: turns are ordered by number (null first), equal numbers by the hash of
role and text; repeated rows (same conversation, number, role and text) count once; a null
role is rendered as an empty name, a null text as empty text, but null and empty differ
for the comparison; null conversation ids form one conversation; an empty table gives no
rows; other columns are ignored. ``<|`` inside a text is rendered as ``< |``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.hilbert import sorted_parts
from tidepanel.session import materialize

SEGMENT = 1024


def _keyed(turns: DataFrame) -> DataFrame:
    """The turns with two hashes of role and text and two of the whole row."""
    role, text = F.col("role"), F.col("text")
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.cast("string"), text.cast("string"))
    # the hashes of a pair differ in the order and the constant that are hashed
    t = (t.withColumn("h1", F.xxhash64(F.lit(1), role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit(""))))
         .withColumn("h2", F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")), F.lit(2), role.isNull(), F.coalesce(role, F.lit("")))))
    place = [F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)), F.col("turn").isNull(), F.coalesce("turn", F.lit(0))]
    return t.withColumns({"k1": F.xxhash64(F.lit(1), *place, "h1"), "k2": F.xxhash64("h2", *place, F.lit(2))})


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, n_turns, p1, p2, k1, k2``: place (from 1), prefix hashes and row key of each turn, without its text."""
    narrow = _keyed(turns).select("conv_id", "turn", "h1", "h2", "k1", "k2").dropDuplicates(["k1", "k2"])
    t = sorted_parts(narrow, ["conv_id", "turn", "h1", "h2"]).withColumnRenamed("_part", "block")
    block = Window.partitionBy("conv_id", "block").orderBy("_place")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    offsets = counts.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
                            F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    t = _back(t, offsets).withColumn("pos", F.col("skip") + F.row_number().over(block))
    t = t.withColumn("g1", F.xxhash64("pos", "h1", "h2")).withColumn("g2", F.xxhash64("h2", "pos", "h1"))
    xors = t.groupBy("conv_id", "block").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    start = xors.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(b) for x, b in (("x1", "b1"), ("x2", "b2"))])
    run = block.rowsBetween(Window.unboundedPreceding, 0)
    t = _back(t, start)
    return t.select("conv_id", "pos", "n_turns",
                    F.bit_xor("g1").over(run).bitwiseXOR(F.col("b1")).alias("p1"),
                    F.bit_xor("g2").over(run).bitwiseXOR(F.col("b2")).alias("p2"), "k1", "k2")


def _back(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    b = blocks.withColumnsRenamed({"conv_id": "_c", "block": "_b"})
    same = turns["conv_id"].eqNullSafe(b["_c"]) & (turns["block"] == b["_b"])
    return turns.join(b, same).drop("_c", "_b")


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id`` of conversations that are no prefix of a longer one (one per equal set)."""
    whole = (prefixes.where(F.col("pos") == F.col("n_turns")).groupBy("n_turns", "p1", "p2")
             .agg(F.min("conv_id").alias("conv_id")))
    # distinct first: a first turn that everyone shares is one row, not one per conversation
    proper = (prefixes.where(F.col("pos") < F.col("n_turns")).select(F.col("pos").alias("n_turns"), "p1", "p2").distinct())
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id")


def render(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, n_turns, text`` of the maximal conversations."""
    p = materialize(prefix_hashes(turns), "chat_prefixes")
    keep = maximal(p).withColumnRenamed("conv_id", "_keep")
    # stored, so that Spark knows its size when it joins the texts
    places = materialize(p.join(keep, p["conv_id"].eqNullSafe(keep["_keep"]), "left_semi")
                         .select("k1", "k2", "pos", F.floor((F.col("pos") - 1) / segment).alias("segment"), "n_turns"), "chat_places")
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"),
                    F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("\n"))
    # a set: repeated rows share a place and count once
    parts = (_keyed(turns).select("conv_id", "k1", "k2", said.alias("said")).join(places, ["k1", "k2"])
             .groupBy("conv_id", "segment", "n_turns").agg(F.array_sort(F.collect_set(F.struct("pos", "said"))).alias("parts")))
    return parts.select("conv_id", "segment", "n_turns", F.array_join(F.col("parts.said"), "").alias("text"))
