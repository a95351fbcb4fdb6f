"""Sharding along a Hilbert curve over quantised metadata.

Every dimension (a column or expression) is cut into ``2**bits`` cells at quantiles over all
rows: approximate ones for numbers, exact ones for strings (from the counts of their distinct
values); the cell coordinates give the index on a Hilbert curve. Rows are ranked by (index,
checksum, size, id) and the ranking is cut into shards whose row counts differ by at most
one. Neighbours on the curve are close in every dimension, so a file's minimum and maximum
prune on each of them. Equal texts of one language and source stand side by side: they share
a shard unless a cut between two shards falls among them, which the law of equal row counts
asks for.

The texts are read once, into narrow rows; cells, curve and order work on those. The ranking
is a range-partitioned sort of narrow rows: partition sizes (one row per
partition) give the offsets. The sort key ends in the id, so a hot cell is cut like any
other range.

Defined results: null text has size 16 and the checksum of the empty text; a null
dimension sorts as the lowest cell, a null string as the empty one; repeated rows take
neighbouring places; with fewer
rows than shards the first shards hold one row each; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tidepanel.session import materialize, reliable_checkpoint

SHARDS = 40
BITS = 5
ROW_BYTES = 16


def curve_index(cells: pd.DataFrame, bits: int) -> pd.Series:
    """Hilbert index of integer cell coordinates (one column per dimension).

    Skilling's transform: coordinates are turned, bit by bit from the top, into the Gray
    code of the curve, whose interleaved bits are the index.
    """
    import numpy as np

    x = [cells.iloc[:, i].to_numpy(dtype=np.int64).copy() for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(inverted, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ flip) >> b) & 1)
    return pd.Series(index)


def sorted_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in range partitions sorted by ``keys``, with ``_part`` and ``_place``, stored.

    The number of partitions follows the shuffle's bytes, not the cores.
    """
    return reliable_checkpoint(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def _starts(sizes: list[tuple[int, int]]) -> tuple[dict[int, int], int]:
    """Running total before each partition (one entry per partition) and the grand total."""
    starts, total = {}, 0
    for part, n in sorted(sizes):
        starts[part] = total
        total += n
    return starts, total


def string_edges(df: DataFrame, name: str, cells: int) -> list[str]:
    """Lower bounds of the cells after the first: the values at which the row count passes i / cells of all.

    From the counts of the distinct values, added up within range partitions of them.
    """
    counts = df.groupBy(name).agg(F.count("*").alias("_n"))
    ordered = sorted_parts(counts, [name])
    starts, total = _starts([(r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.sum("_n").alias("n")).collect()])
    if not total:
        return []
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "_part int, _start long")
    before = F.col("_start") + F.sum("_n").over(Window.partitionBy("_part").orderBy("_place")) - F.col("_n")
    placed = ordered.join(F.broadcast(offsets), "_part").withColumn("_before", before)
    # the cell of a value's first row; the smallest value of a cell bounds it from below
    cell = F.expr(f"_before * {cells} div {total}")
    rows = placed.groupBy(cell.alias("cell")).agg(F.min(name).alias("edge")).where("cell > 0").collect()  # at most 2**bits rows
    return sorted((r["edge"] for r in rows), key=lambda x: x.encode())


def with_curve_index(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Adds ``cell_<name>`` per dimension (a number or a string) and ``curve``, their Hilbert index."""
    if bits * len(dimensions) > 62:
        raise ValueError("the index must fit in 62 bits")
    df = df.withColumns({f"_d_{k}": v for k, v in dimensions.items()})
    strings = [k for k in dimensions if isinstance(df.schema[f"_d_{k}"].dataType, StringType)]
    numbers = [k for k in dimensions if k not in strings]
    df = df.withColumns({f"_d_{k}": F.coalesce(f"_d_{k}", F.lit("")) for k in strings} |
                        {f"_d_{k}": F.coalesce(F.col(f"_d_{k}").cast("double"), F.lit(float("-inf"))) for k in numbers})
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    edges = {k: string_edges(df, f"_d_{k}", 1 << bits) for k in strings}
    if numbers:
        row = df.agg(*[F.percentile_approx(f"_d_{k}", cuts, 10_000).alias(k) for k in numbers]).first()
        edges |= {k: sorted(set(row[k] or [])) for k in numbers}
    for k in dimensions:
        # number of edges at or below the value; bounded by 2**bits literals
        value = F.col(f"_d_{k}")
        cell = sum(((value >= F.lit(e)).cast("int") for e in edges[k]), F.lit(0))
        df = df.withColumn(f"cell_{k}", cell).drop(f"_d_{k}")

    names = [f"cell_{k}" for k in dimensions]

    @pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return curve_index(cells, bits)

    return df.withColumn("curve", index(F.struct(*names)))


def rank(df: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """Adds the global rank (from 0) by ``keys`` without a single-task sort."""
    ordered = sorted_parts(df, keys)
    starts, total = _starts([(r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()])
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "_part int, _start long")
    return (ordered.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_start") + F.col("_place"))
            .withColumn("_total", F.lit(total).cast("long")).drop("_part", "_place", "_start"))


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, curve, shard, slot`` and the cells of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    narrow = materialize(narrow, "shard_rows")  # the texts are read once
    placed = with_curve_index(narrow, {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("size")}, bits)
    ranked = rank(placed.drop("lang", "source"), ["curve", "text_crc32", "size", "doc_id"])
    ranked = ranked.withColumn("shard", F.expr(f"int(rank * {shards} div _total)"))
    # first rank r with r * shards >= shard * total
    ranked = ranked.withColumn("slot", F.expr(f"rank - (shard * _total + {shards - 1}) div {shards}"))
    return ranked.drop("rank", "_total")
