"""Filter interaction audit: every order of five filters, from difference arrays over ranks.

A document fails a set of filters, its mask. In an order of the filters it is removed at
the step of the first filter it fails, so its step is fixed by a prefix of the order:
``k - 1`` filters outside the mask, then one inside. In lexicographic order (Lehmer ranks 0
to 119) the orders with a common prefix of length ``k`` are one interval of ``(5 - k)!``
ranks. Counts per (part, mask) are therefore added at the starts of the intervals and taken
off behind their ends, and one prefix sum over the 120 ranks gives what every step of every
order removes. Everything else is algebra on that table: what is kept (all steps up to this
one), what fails a filter but is gone already (its failures less its removals), and the sum
over all orders.

The tests of a document depend on its text alone. Copies are counted per (text digest,
part, labels) before anything meets by digest, so a group of copies costs a few rows
whatever its size; the smallest id of a digest is the copy that passes filter E.

Defined results: a null text is the empty text, and all empty texts are copies of each
other; a null source is the empty string; rows with a null id are never copies and make
none; repeated rows count each, and those with the smallest id all pass filter E; a
document without labels is neither good nor toxic, one with several label rows is good
(toxic) if any of them says so; texts are read whole; an empty table gives no rows; only
the named columns are read, so clashing extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import text as T
from tidepanel.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]  # by Lehmer rank
COUNTS = ["n", "good", "toxic"]
MIN_WORDS = 200
DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 2
SYMBOLS = "[#$%&*|]"


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """``(step, first rank, last rank + 1)`` of the orders that remove a mask at a step."""
    own = [i for i in range(len(FILTERS)) if mask >> i & 1]
    rest = [i for i in range(len(FILTERS)) if not mask >> i & 1]
    found = []
    for step in range(1, len(FILTERS) + 1):
        width = math.factorial(len(FILTERS) - step)
        starts = sorted(_rank((*before, last)) for before in itertools.permutations(rest, step - 1) for last in own)
        for lo in starts:
            if found and found[-1][0] == step and found[-1][2] == lo:  # neighbours are one interval
                found[-1] = (step, found[-1][1], lo + width)
            else:
                found.append((step, lo, lo + width))
    return found


def _rank(prefix: tuple[int, ...]) -> int:
    """Lehmer rank of the first order that begins with a prefix."""
    left = list(range(len(FILTERS)))
    rank = 0
    for i in prefix:
        rank += left.index(i) * math.factorial(len(left) - 1)
        left.remove(i)
    return rank


def _text_bits(docs: DataFrame) -> DataFrame:
    """Adds ``bits``, the failures that the text alone decides, and the text's ``digest``."""
    d = T.fixed(docs, words=T.space_words(F.col("text")))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n,
             100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("text"), F.col("text").rlike(SYMBOLS)]
    bits = reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])
    return d.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part that fail just these filters."""
    d = _text_bits(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                               F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part")))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))])
    rows = d.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("c"))
    rows = rows.join(marked, "doc_id", "left").na.fill(0, ["good", "toxic"])
    known = F.col("doc_id").isNotNull()
    copies = rows.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("c").alias("n"), F.min(F.when(known, F.struct("doc_id", "c"))).alias("low"), F.sum(F.when(known, 0).otherwise(F.col("c"))).alias("free"))
    # the rows of the smallest id of a text pass E; all of one id have equal text and labels here
    first = copies.groupBy("digest").agg(F.min("low.doc_id").alias("first"))
    copies = copies.join(first, "digest")
    passing = F.col("free") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.c")).otherwise(0)
    both = F.array(F.struct(F.col("bits").alias("mask"), passing.alias("n")),
                   F.struct((F.col("bits") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - passing).alias("n")))
    split = copies.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in COUNTS[1:]])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``part, filter_order, step`` and the counts of that step, 600 rows a part.

    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, all long.
    """
    spark = docs.sparkSession
    counted = materialize(masks(docs, labels, id_col, text_col, source_col), "audit_masks")
    rules = spark.createDataFrame([(m, *x) for m in range(1, 1 << len(FILTERS)) for x in intervals(m)], "mask int, step int, lo int, hi int")
    ends = F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign")))
    changes = (counted.join(F.broadcast(rules), "mask").select("part", "step", *COUNTS, F.inline(ends)).where(F.col("rank") < len(ORDERS))
               .select("part", "step", "rank", *[(F.col(c) * F.col("sign")).alias(c) for c in COUNTS]))
    fails = lambda i: F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0))
    alone = lambda i: F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0))
    totals = counted.groupBy("part").agg(F.sum("n").alias("total"), F.array(*map(fails, range(len(FILTERS)))).alias("fails"),
                                         F.array(*map(alone, range(len(FILTERS)))).alias("alone"))
    steps = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    zeros = steps.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"),
                         *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    cells = changes.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gone = cells.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in COUNTS])
    earlier = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gone = gone.withColumn("so_far", F.sum("n").over(earlier))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("rank") + 1)
    gone = gone.withColumn("filter_order", order)
    gone = gone.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    gone = gone.withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "letter"))).join(totals, "part")
    own = F.instr(F.lit(FILTERS), F.col("letter"))
    return gone.select("part", "filter_order", "step", (F.col("total") - F.col("so_far")).alias("kept"), F.col("n").alias("removed"),
                       (F.element_at("fails", own) - F.col("n")).alias("redundant"), F.element_at("alone", own).alias("unique_fails"),
                       F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
