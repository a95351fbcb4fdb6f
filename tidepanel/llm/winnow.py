"""Benchmark decontamination by winnowing (DataFrame functions only).

Every text is reduced to fingerprints: the minimum hash of each run of ``w`` consecutive
``k``-word grams. Two texts that share ``k + w - 1`` consecutive words share such a run
and therefore its minimum, so joining fingerprints cannot miss a shared window of that
length. Each joined fingerprint is then extended word by word: all windows around it are
compared exactly, so hash collisions never reach the result.

A fingerprint travels with the few words that its windows can reach (at most
``window + w - 1`` a place), never with its whole text, so the joined rows grow linearly
with the length of an item or document. Narrow rows find the documents that share any
fingerprint; only those are read again and cut into words around their fingerprints.

Defined results: a null or empty text has no words and is never contaminated; a null or
empty item has no window; items shorter than the window are one window and are found
through their own gram lengths; repeated documents get equal rows; repeated items count
once per id (a null id counts as the empty string); empty tables give empty results or
clean rows. Only the id and text columns are read, so clashing extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm import text as T
from tidepanel.session import materialize

WINDOW = 10
K = 5
RUN = WINDOW - K + 1  # k-grams per window: the guarantee is K + RUN - 1 = WINDOW words
BROADCAST_FINGERPRINTS = 500_000  # rows; above it, or above the bytes, the fingerprints are shuffled
NULL_ID = (1 << 63) - 1  # stands for a null id in the list of contaminated rows
BROADCAST_BYTES = 64 << 20  # of fingerprint rows with their words


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each ``k`` consecutive word hashes (empty when there are fewer)."""
    n = F.size(hashes)
    every = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)]))
    return F.when(n >= k, F.slice(every, F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(T.empty_longs())


def _minima(grams: Column, run: int) -> Column:
    """Minimum of each ``run`` consecutive gram hashes."""
    if run == 1:
        return grams
    n = F.size(grams)
    minima = F.transform(grams, lambda g, i: F.least(g, *[F.get(grams, i + j) for j in range(1, run)]))
    return F.when(n >= run, F.slice(minima, F.lit(1), F.greatest(n - (run - 1), F.lit(1)))).otherwise(T.empty_longs())


def _worded(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``words`` and their hashes ``wh``."""
    return T.fixed(df, words=T.alnum_words(F.col(text_col)), wh=F.transform("words", lambda w: F.xxhash64(w)))


def _around(worded: DataFrame, gram: int, run: int, length: Column) -> DataFrame:
    """Adds ``around``: (``at, fp, lead, near``) of every gram that is the minimum of a run.

    ``near`` are the words that windows around the gram reach, ``lead`` of them before it.
    """
    cut = T.fixed(worded, grams=_grams(F.col("wh"), gram))
    cut = T.fixed(cut, minima=_minima(F.col("grams"), run))
    offsets = F.sequence(F.lit(0), F.lit(run - 1))
    chosen = F.filter(F.sequence(F.lit(0), F.size("grams") - 1),
                      lambda p: F.exists(offsets, lambda o: F.get("minima", p - o) == F.get("grams", p)))
    cut = T.fixed(cut, chosen=chosen)

    def one(p):
        lead = F.least(p, F.lit(run - 1))
        return F.struct(p.alias("at"), F.get("grams", p).alias("fp"), lead.alias("lead"),
                        F.slice("words", p - lead + 1, lead + length).alias("near"))

    return T.fixed(cut, around=F.transform("chosen", one)).drop("grams", "minima", "chosen")


def _item_rows(items: DataFrame, gram: int, run: int, length: Column) -> DataFrame:
    """``len, fp, item, places, bytes``: one row per fingerprint of an item.

    ``places`` holds the distinct (``lead, near``) of the fingerprint; ``bytes`` is about
    the row's size.
    """
    rows = (_around(items, gram, run, length).select("item", F.inline("around")).groupBy("fp", "item")
            .agg(F.collect_set(F.struct("lead", "near")).alias("places")))
    words = F.flatten(F.transform("places", lambda x: x["near"]))
    size = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + 16 + F.octet_length(w))
    return rows.select(length.alias("len"), "fp", "item", "places",
                       (size + 32 * F.size("places") + 40 + F.octet_length("item")).alias("bytes"))


def _sharing(docs: DataFrame, items: DataFrame, gram: int, run: int, bounded: bool) -> DataFrame:
    """``doc_id, key`` of the documents that share a fingerprint with any item."""
    cut = T.fixed(docs, grams=_grams(F.col("wh"), gram))
    cut = T.fixed(cut, fps=F.array_distinct(_minima(F.col("grams"), run)))
    fps = items.select("fp").distinct()
    return (cut.select("doc_id", "key", F.explode("fps").alias("fp"))
            .join(F.broadcast(fps) if bounded else fps, "fp", "left_semi").select("doc_id", "key"))


def _windows(docs: DataFrame, items: DataFrame, gram: int, run: int, length: Column, bounded: bool) -> DataFrame:
    """``doc_id, key, item, start, len``: occurrences of item windows in documents.

    ``items`` has the rows of ``_item_rows``; windows are ``length`` words long and hold
    ``run`` grams of ``gram`` words. All offsets of a window around a shared gram are tried.
    """
    rows = _around(docs, gram, run, length).select("doc_id", "key", F.inline("around"))
    hit = rows.join(F.broadcast(items) if bounded else items, "fp")

    def window(lead, near, o):
        return F.slice(near, F.greatest(lead - o + 1, F.lit(1)), length)

    def fits(lead, near, o):
        return (lead >= o) & (lead - o + length <= F.size(near))

    lead, near = F.col("lead"), F.col("near")
    same = F.filter(F.sequence(F.lit(0), F.lit(run - 1)), lambda o: fits(lead, near, o) & F.exists(
        "places", lambda y: fits(y["lead"], y["near"], o) & (window(lead, near, o) == window(y["lead"], y["near"], o))))
    return hit.select("doc_id", "key", "item", F.explode(F.transform(same, lambda o: F.col("at") - o)).alias("start"),
                      length.alias("len")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K,
                  broadcast_rows: int = BROADCAST_FINGERPRINTS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: word counts, hit words, items found, verdict.

    Returns ``doc_id, key, n_words, n_hit, n_items, items`` (sorted array of item ids as
    strings) and ``contaminated``.
    """
    run = window - k + 1
    base = T.documents(docs, id_col, text_col).withColumn("key", T.text_key(F.col("text")))
    worded = _worded(base, "text").select("doc_id", "key", "words", "wh")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text_col).cast("string").alias("t")).distinct()
    items = _worded(items, "t").select("item", "words", "wh").where(F.size("words") > 0)
    # at most window - 1 short lengths
    short = items.agg(F.collect_set(F.when(F.size("words") < window, F.size("words"))).alias("short")).first()["short"]
    cuts = [(window, k, run), *[(m, m, 1) for m in sorted(short)]]
    parts = [_item_rows(items.where(F.size("words") >= n if n == window else F.size("words") == n), gram, r, F.lit(n))
             for n, gram, r in cuts]
    rows = materialize(reduce(DataFrame.unionByName, parts), "winnow_items")
    sent = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    bounded = sent["n"] <= broadcast_rows and (sent["bytes"] or 0) <= broadcast_bytes
    rows = {n: rows.where(F.col("len") == n).select("fp", "item", "places") for n, *_ in cuts}
    sharing = materialize(reduce(DataFrame.unionByName, [
        _sharing(worded, rows[n], gram, r, bounded) for n, gram, r in cuts]).distinct(), "winnow_sharing")
    few = sharing.count() <= broadcast_rows
    own = sharing.select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    read = base.join(F.broadcast(own) if few else own, base["doc_id"].eqNullSafe(own["d"]) & (base["key"] == own["k"]), "left_semi")
    again = _worded(read, "text").select("doc_id", "key", "words", "wh")
    found = reduce(DataFrame.unionByName, [_windows(again, rows[n], gram, r, F.lit(n), bounded) for n, gram, r in cuts])

    # union of the hit intervals of each document, one row per start
    spans = found.groupBy("doc_id", "key", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy("doc_id", "key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = (found.select("doc_id", "key", "item").distinct().groupBy("doc_id", "key")
             .agg(F.array_sort(F.collect_list("item")).alias("items")))
    got = hits.join(named, hits["doc_id"].eqNullSafe(named["doc_id"]) & (hits["key"] == named["key"])).select(
        hits["doc_id"].alias("d"), hits["key"].alias("k"), "n_hit", "items")
    counted = base.select("doc_id", "key", F.size(T.alnum_words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(got, counted["doc_id"].eqNullSafe(got["d"]) & (counted["key"] == got["k"]), "left")
    return out.select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, all columns kept.

    The contaminated (id, text key) pairs are stored first; below ``T.BROADCAST_KEYS`` rows
    they are broadcast, so no text is shuffled.
    """
    bad = decontaminate(docs, benchmark).where("contaminated").select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "key").distinct()
    return T.without_keys(docs, materialize(bad, "winnow_contaminated"), NULL_ID)
