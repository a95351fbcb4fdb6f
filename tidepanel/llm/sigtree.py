"""N-gram Jaccard join with signature trees.

A document's set holds its distinct shingles of ``words`` words (64-bit hashes). Two documents link
when ``100 * |A & B| >= percent * |A | B|``; the result is exact up to hash collisions.

1. One scan gives each set's size and 128-bit fingerprint (equal sets are one class from
   here on) and the counts of hashed shingle buckets over the whole corpus.
2. The shingles of a set are ordered by (bucket count, hash). Linked sets share one of
   their first ``n - ceil(percent * n / 100) + 1`` shingles, so a document is routed to the
   roots of those shingles; roots that only one set reaches are dropped. Common passages
   have high counts and come last, so they open no roots. Prefixes extended by ``l - 1``
   hold ``l`` common shingles of linked sets; sets with fewer shingles that any other
   set's prefix holds are dropped before anything is compared.
3. Below a root sets are split by size class (linked sets are in the same or in adjacent
   classes) and, where there are many, into slices. A task builds a signature tree over a
   slice: nodes hold the OR of the bitmaps below them (at least ``BITS`` bits a shingle, rounded
   up to a power of two), the range of sizes and the largest number of shingles hidden by
   equal bits. Two trees are traversed together; a pair of nodes is left when the largest
   overlap possible is too small for the smallest sizes.
4. Surviving pairs are verified on the texts, in rounds of at most one pair per set. In the
   first round every set meets the sets below one of its roots (the one that most sets
   reach) and takes the partner with the largest possible similarity; in the second it
   takes the best one over all its roots, from another component of the links verified so
   far. Last, all pairs whose ends are still in different components are traversed and
   verified. A group of copies therefore costs its size, not its square, and no link
   between different components is lost.

Sets are told apart by size and both fingerprints throughout. Until the verification only
narrow rows and bitmaps move; texts are read for the two ends of a pair.

Defined results: a null or empty text has the empty set, links with nothing and is its own
component; texts of fewer words are one shingle; repeated documents share a
component; rows with one id and different texts are one node; a null id is a node of its
own kind (all null ids together) and comes back as null unless a smaller id is reachable;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import graph
from tidepanel.llm.shingle import SHINGLE_WORDS, collected, mix, shingle_sets
from tidepanel.llm.text import quoted, text_key, with_keys, without_keys
from tidepanel.session import materialize

PERCENT = 85
BUCKET_BITS = 16
EXTRA_PERCENT = 5  # of a set's shingles, by which its prefix is extended
MIN_FILTER_BITS, MAX_FILTER_BITS = 20, 30  # of the shared-root filter that is broadcast (128 MB at most)
SLICE = 2048  # sets of one root and size class in one tree
LEAF, FANOUT = 32, 8
BITS = 8  # bits of a bitmap for each shingle
BROADCAST_PAIRS = 200_000  # rows of pairs (three numbers each) that are broadcast to the texts
NULL_ID = (1 << 63) - 1  # stands for a null id inside the operator
GROUP = ["token", "class", "part", "class2", "part2"]  # a pair of slices below one root


def _marks(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set (sums of scrambled members)."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(seed)))]) for seed in (11, 23)]
    return tuple((t[cuts[1:]] - t[cuts[:-1]]).view(np.int64) for t in total)


def _describe(words: int):
    """One row per document (kind 0) and, at the end, bucket counts of the task (kind 1)."""
    def run(batches: Iterator):
        import pyarrow as pa

        names = ["kind", "doc_id", "key", "n", "f1", "f2"]
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for a, hashes, cuts in shingle_sets(batch.column(2), words):
                counts += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
                n = np.diff(cuts)
                f1, f2 = _marks(hashes, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0).slice(a, len(n)),
                                                  batch.column(1).slice(a, len(n)), pa.array(n), pa.array(f1), pa.array(f2)], names=names)
        used = np.nonzero(counts)[0]
        none = pa.array(np.zeros(len(used), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used), none, pa.array(counts[used]), none, none], names=names)
    return run


def _ordered(hashes: np.ndarray, cuts: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the extended prefix of each set, the set they belong to, and whether
    they are in the plain prefix (any of which may be the first shared shingle)."""
    n = np.diff(cuts)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, counts[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], owner))
    place = np.arange(len(hashes)) - np.repeat(cuts[:-1], n)
    plain = np.repeat(n + (percent * n) // -100 + 1, n)
    take = place < plain + np.repeat(_more(n), n)
    return order[take], owner[take], (place < plain)[take]


def _more(n: np.ndarray) -> np.ndarray:
    """Shingles by which the prefix of a set of size ``n`` is extended."""
    return -(-n * EXTRA_PERCENT // 100) - (n > 0)


def _shared_needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that the extended prefix of a linked set holds at least.

    Of the first ``l`` common shingles of two linked sets all lie in both prefixes extended
    by ``l - 1``; the partner has at least ``percent`` of the size.
    """
    smallest = -(-n * percent // 100)
    return np.minimum(_more(n), _more(smallest)) + 1


def _prefixes(shared, percent: int, words: int):
    """(token, f1): the roots each set is routed to."""
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for _, hashes, cuts in shingle_sets(batch.column(0), words):
                take, owner, _ = _ordered(hashes, cuts, shared.value, percent)
                f1, _ = _marks(hashes, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[take].view(np.int64)), pa.array(f1[owner])], names=["token", "f1"])
    return run


def _filter_slot(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens.view(np.uint64) + np.uint64(77)) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits of a set, at least ``BITS`` for each member, a power of two in all."""
    width = max(64, 1 << int(BITS * len(hashes) - 1).bit_length())
    slot = (hashes & np.uint64(width - 1)).astype(np.int64)
    bits = np.zeros(width, dtype=np.uint8)
    bits[slot] = 1
    return np.packbits(bits, bitorder="little")


def _members(counts_shared, filter_shared, filter_bits: int, percent: int, words: int):
    """Sets with enough shared shingles, once a task: size, fingerprints, roots, bitmap, text."""
    def run(batches: Iterator):
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()  # sets of this task only
        for batch in batches:
            for a, hashes, cuts in shingle_sets(batch.column(0), words):
                take, owner, plain = _ordered(hashes, cuts, counts_shared.value, percent)
                slot = _filter_slot(hashes[take], filter_bits)
                hit = (filter_shared.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
                enough = np.bincount(owner[hit], minlength=len(cuts) - 1) >= _shared_needed(np.diff(cuts), percent)
                f1, f2 = _marks(hashes, cuts)
                for i in np.nonzero(enough)[0].tolist():
                    key = (int(f1[i]), int(f2[i]))
                    enough[i] = key not in seen
                    seen.add(key)
                hit &= plain & enough[owner]
                take, owner = take[hit], owner[hit]
                own, first = np.unique(owner, return_index=True)
                if not len(own):
                    continue
                tokens = pa.ListArray.from_arrays(pa.array(np.append(first, len(take)).astype(np.int32)), pa.array(hashes[take].view(np.int64)))
                bits = [bitmap(hashes[cuts[i]:cuts[i + 1]]) for i in own]
                half = [(b[:len(b) // 2] | b[len(b) // 2:] if len(b) > 8 else b).tobytes() for b in bits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(cuts)[own]), pa.array(f1[own]), pa.array(f2[own]), tokens, pa.array([b.tobytes() for b in bits], pa.binary()),
                     pa.array(half, pa.binary()), batch.column(0).take(pa.array(own + a))], names=["n", "f1", "f2", "tokens", "bits", "coarse", "text"])
    return run


class Tree:
    """Signature tree over sets given by sizes and bitmaps of one common width."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ones = np.bitwise_count(bits).sum(1).astype(np.int64)
        cuts = np.arange(0, len(sizes), LEAF)
        hidden = sizes - self.ones
        self.levels = [(np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(sizes, cuts), np.maximum.reduceat(sizes, cuts), np.maximum.reduceat(hidden, cuts))]
        while len(self.levels[-1][1]) > 1:
            union, low, high, hid = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(union, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(hid, cuts)))


def _possible(union_a, low_a, high_a, hid_a, union_b, low_b, high_b, hid_b, percent: int) -> np.ndarray:
    """Whether sets below node ``a`` and below each node ``b`` can link."""
    most = np.bitwise_count(union_a & union_b).sum(1).astype(np.int64) + np.minimum(hid_a, hid_b)
    most = np.minimum(most, np.minimum(high_a, high_b))
    sized = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    return sized & ((100 + percent) * most >= percent * (low_a + low_b))


def traverse(left: Tree, right: Tree, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs (set of ``left``, sets of ``right``) that no bound excludes, and their largest
    possible similarity."""
    top_a, top_b = len(left.levels) - 1, len(right.levels) - 1
    stack = [(top_a, 0, top_b, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        if la == 0 and lb == 0:
            own = slice(b * LEAF, (b + 1) * LEAF)
            n = right.sizes[own]
            for i in range(a * LEAF, min((a + 1) * LEAF, len(left.sizes))):
                hidden = np.minimum(left.sizes[i] - left.ones[i], n - right.ones[own])
                most = np.bitwise_count(left.bits[i] & right.bits[own]).sum(1).astype(np.int64) + hidden
                most = np.minimum(most, np.minimum(n, left.sizes[i]))
                good = np.nonzero((100 + percent) * most >= percent * (n + left.sizes[i]))[0]
                if len(good):
                    yield i, good + b * LEAF, most[good] / (n + left.sizes[i] - most)[good]
            continue
        if la >= lb and la > 0:  # open the higher node
            u, low, high, hid = right.levels[lb]
            c = slice(a * FANOUT, (a + 1) * FANOUT)
            x = left.levels[la - 1]
            ok = _possible(u[b], low[b], high[b], hid[b], x[0][c], x[1][c], x[2][c], x[3][c], percent)
            stack += [(la - 1, a * FANOUT + int(j), lb, b) for j in np.nonzero(ok)[0]]
        else:
            u, low, high, hid = left.levels[la]
            c = slice(b * FANOUT, (b + 1) * FANOUT)
            x = right.levels[lb - 1]
            ok = _possible(u[a], low[a], high[a], hid[a], x[0][c], x[1][c], x[2][c], x[3][c], percent)
            stack += [(la, a, lb - 1, b * FANOUT + int(j)) for j in np.nonzero(ok)[0]]


def _fold(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps cut to ``width`` bytes by OR-ing their parts."""
    out = np.empty((len(bits), width), np.uint8)
    for i, b in enumerate(bits):
        row = np.frombuffer(b, np.uint8)
        out[i] = row if len(row) == width else np.bitwise_or.reduce(row.reshape(-1, width), 0)
    return out.view(np.uint64)


def _group_pairs(ids, sizes, bits, side, component, percent: int, one: bool) -> tuple[list[int], list[int], list[float]]:
    """Pairs between side 0 and side 1 of a group, or within side 0 if it is alone.

    Only pairs of different components, with their largest possible similarity; ``one``:
    only the best partner of each set of side 0 (ties go to the smaller number).
    """
    width = min(map(len, bits))
    folded = _fold(bits, width)
    order = np.lexsort((*folded.T[:4][::-1], side))
    ids, sizes, side, folded, component = ids[order], sizes[order], side[order], folded[order], component[order]
    cut = int(np.searchsorted(side, 1))
    if not cut:
        return [], [], []
    left = Tree(sizes[:cut], folded[:cut])
    alone = cut == len(ids)
    base = 0 if alone else cut
    best: dict[int, tuple[float, int]] = {}
    x: list[int] = []
    y: list[int] = []
    score: list[float] = []
    for i, js, near in traverse(left, left if alone else Tree(sizes[cut:], folded[cut:]), percent):
        js = js + base
        keep = component[js] != component[i]
        if alone and not one:
            keep &= js < i
        js, near = js[keep], near[keep]
        if not len(js):
            continue
        if one:
            top = near.max()
            found = (float(top), -int(ids[js[near == top]].min()))
            best[i] = max(best.get(i, found), found)
        else:
            x += [int(ids[i])] * len(js)
            y += ids[js].tolist()
            score += near.tolist()
    for i, (top, j) in best.items():
        x.append(int(ids[i]))
        y.append(-j)
        score.append(top)
    return x, y, score


def _pairs(percent: int, one: bool):
    """Candidate pairs of a stream of groups (rows of a group stand together)."""
    def run(batches: Iterator):
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in GROUP])
            cuts = np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1])
            yield from _emit(table, cuts, percent, one, pa)
            held = table.slice(int(cuts[-1]))  # the last group may go on
        if held is not None and held.num_rows:
            yield from _emit(held, np.array([0, held.num_rows]), percent, one, pa)
    return run


def _emit(table, cuts: np.ndarray, percent: int, one: bool, pa):
    ids, sizes, side, comp = (table.column(c).to_numpy() for c in ("id", "n", "side", "component"))
    bits = table.column("bits")
    a: list[int] = []
    b: list[int] = []
    score: list[float] = []
    group: list[int] = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo > 1:
            x, y, near = _group_pairs(ids[lo:hi], sizes[lo:hi], bits.slice(lo, hi - lo).to_pylist(), side[lo:hi], comp[lo:hi], percent, one)
            a += x
            b += y
            score += near
            group += [lo] * len(x)
    if a:
        keys = table.select(GROUP).take(pa.array(group, pa.int64())).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64()),
                                          *[keys.column(c).chunk(0) for c in GROUP]], names=["x", "y", "score", *GROUP])


def _verify(percent: int, words: int):
    """Keeps the pairs whose texts really link."""
    def run(batches: Iterator):
        import pyarrow as pa

        def sets(column):
            for _, hashes, cuts in shingle_sets(column, words):
                for i in range(len(cuts) - 1):
                    yield hashes[cuts[i]:cuts[i + 1]]

        for batch in batches:
            keep = []
            for p, q in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep))
    return run


def bit_filter(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A one-hash Bloom filter of a long column, as 64-bit words.

    Its size follows the number of keys up to ``MAX_FILTER_BITS``, so what is collected
    and broadcast is bounded; beyond that it only lets more rows through.
    """
    n = keys.count()
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, (16 * n).bit_length()))

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            slot = _filter_slot(batch.column(0).to_numpy(), bits)
            word, at = np.unique(slot >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (slot & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    got = collected(keys.select(column).mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")))
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"]] = got["value"].view(np.uint64)
    return out, bits


def _root_rows(roots: DataFrame) -> DataFrame:
    """Roots that at least two sets reach, each distinct set of them once.

    ``roots`` is (token, id, n); ``m`` is added, the number of sets. Roots with equal lists of
    sets would give equal pairs, so one of them stands for all (lists are compared by count
    and two XOR hashes).
    """
    lists = roots.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x1"),
                                       F.bit_xor(F.xxhash64(F.lit(3), "id")).alias("x2")).where("m > 1")
    return roots.join(lists.groupBy("m", "x1", "x2").agg(F.min("token").alias("token")).select("token", "m"), "token")


def _groups(rows: DataFrame, within_only: bool) -> DataFrame:
    """Rows of each pair of slices that may hold links between different components.

    ``rows`` is (token, class, slice, id, n, component). A slice meets itself, the
    later slices of its class and the slices of the next class; pairs of slices that lie
    in one component are left out before any row is copied.
    """
    blocks = rows.groupBy("token", "class", "slice").agg(
        F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    own = blocks.where("m > 1 and low < high").select(
        "token", "class", "slice", F.col("class").alias("class1"), F.col("slice").alias("part"),
        F.col("class").alias("class2"), F.col("slice").alias("part2"), F.lit(0).alias("side"))
    if not within_only:
        b = blocks.withColumnsRenamed({"class": "class2", "slice": "part2", "low": "low2", "high": "high2"}).drop("m")
        near = (((F.col("class2") == F.col("class")) & (F.col("part2") > F.col("slice"))) | (F.col("class2") == F.col("class") + 1))
        mixed = F.least("low", "low2") < F.greatest("high", "high2")
        # the join key keeps the candidates to adjacent classes of one root
        a = blocks.select("*", F.explode(F.array("class", F.col("class") + 1)).alias("class2"))
        two = a.join(b, ["token", "class2"]).where(near & mixed).select(
            "token", F.col("class").alias("class1"), F.col("slice").alias("part"), "class2", "part2")
        own = (own.unionByName(two.select("*", F.col("class1").alias("class"), F.col("part").alias("slice"), F.lit(0).alias("side")))
               .unionByName(two.select("*", F.col("class2").alias("class"), F.col("part2").alias("slice"), F.lit(1).alias("side"))))
    got = rows.join(own, ["token", "class", "slice"])
    return got.select("token", F.col("class1").alias("class"), "part", "class2", "part2", "side", "id", "n", "component")


def _links(groups: DataFrame, members: DataFrame, percent: int, words: int, one: bool) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) of all groups, and the groups (GROUP) in which any pair survived.

    ``members`` has id, bitmaps and text of each set. ``one``: each set verifies the best
    pair only that its groups found, by bitmaps of half the size.
    """
    together = groups.join(members.select("id", F.col("coarse" if one else "bits").alias("bits")), "id").repartition(*GROUP).sortWithinPartitions(*GROUP, "side")
    pairs = together.mapInArrow(_pairs(percent, one), "x long, y long, score double, token long, class long, part long, class2 long, part2 long")
    pairs = materialize(pairs, "sigtree_found")
    alive = pairs.select(*GROUP).distinct()
    if one:
        pairs = pairs.groupBy("x").agg(F.max(F.struct("score", (-F.col("y")).alias("y"))).alias("s")).select("x", (-F.col("s.y")).alias("y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialize(pairs, "sigtree_pairs")
    few = pairs.count() <= BROADCAST_PAIRS
    left = members.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = members.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    if few:
        right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    both = left.join(F.broadcast(pairs) if few else pairs, "a").join(right, "b").select("a", "b", "ta", "tb")
    return materialize(both.mapInArrow(_verify(percent, words), "a long, b long"), "sigtree_links"), alive


def _with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Sets with the component that the links so far put them in."""
    joined = graph.components(links).withColumnRenamed("node", "id")
    return rows.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))


@dataclass
class Joined:
    """What the join found: ``sets`` (doc_id, key, n, f1, f2) of every document, the distinct
    sets (``classes``: n, f1, f2 and their smallest doc_id ``rep``), those that were compared
    (``members``: also numbered ``id``) and the verified ``links`` (a, b) between their numbers."""

    sets: DataFrame
    classes: DataFrame
    members: DataFrame
    links: DataFrame


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
         words: int = SHINGLE_WORDS, slice_rows: int = SLICE) -> Joined:
    """All distinct sets and the links that connect them."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    text = F.col(text_col).cast("string")
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_key(text).alias("key"), text.alias("text"))

    # 1. sizes, fingerprints, bucket counts
    seen = materialize(d.mapInArrow(_describe(words), "kind int, doc_id long, key long, n long, f1 long, f2 long"), "sigtree_sets")
    sets = seen.where("kind = 0").drop("kind")
    classes = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    tally = collected(seen.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")))  # one row per bucket
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[tally["doc_id"]] = tally["n"]
    counts_shared = sc.broadcast(counts)

    # 2. roots that more than one set reaches
    routed = d.select("text").mapInArrow(_prefixes(counts_shared, percent, words), "token long, f1 long")
    shared = routed.groupBy("token").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo < hi").select("token")
    shared = materialize(shared, "sigtree_roots")
    marks, bits = bit_filter(shared, "token")
    found = d.select("text").mapInArrow(_members(counts_shared, sc.broadcast(marks), bits, percent, words),
                                        "n long, f1 long, f2 long, tokens array<long>, bits binary, coarse binary, text string")
    # one row per distinct set, numbered; copies were dropped inside each task before
    found = found.dropDuplicates(["n", "f1", "f2"]).join(classes, ["n", "f1", "f2"])
    members = materialize(found.withColumn("id", F.monotonically_increasing_id()), "sigtree_members")
    own = members.select("id", "n", F.explode("tokens").alias("token"))
    rows = _root_rows(materialize(own, "sigtree_routes"))

    # 3. size classes and slices
    width = float(np.log(100.0 / percent) * 1.001) if percent < 100 else 1e9
    rows = rows.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / width))
    parts = rows.groupBy("token", "class").agg(F.ceil(F.count("*") / slice_rows).alias("parts"))
    rows = rows.join(parts, ["token", "class"]).withColumn("slice", F.pmod(F.xxhash64("id", "token"), F.col("parts"))).drop("parts")
    rows = materialize(rows, "sigtree_rows")

    # 4. the best partner below one root, then over all roots, then all pairs of different components
    chosen = rows.groupBy("id").agg(F.max(F.struct("m", "token", "class", "slice", "n")).alias("r")).select("id", "r.*")
    links, _ = _links(_groups(chosen.withColumn("component", F.col("id")), True), members, percent, words, True)
    more, alive = _links(_groups(_with_components(rows, links), False), members, percent, words, True)
    links = materialize(links.unionByName(more), "sigtree_links")
    # a group without any pair between the components of that round has none between larger ones
    last = _groups(_with_components(rows, links), False).join(alive, GROUP, "left_semi")
    links = links.unionByName(_links(last, members, percent, words, False)[0])
    return Joined(sets, classes, members.select("id", "rep", "n", "f1", "f2"), links)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    words: int = SHINGLE_WORDS, slice_rows: int = SLICE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    found = join(docs, id_col, text_col, percent, words, slice_rows)
    # links between documents; one id with several sets joins their classes
    reps = found.members.select("id", "rep")
    linked = (found.links.join(reps.withColumnsRenamed({"id": "a", "rep": "u"}), "a").join(reps.withColumnsRenamed({"id": "b", "rep": "v"}), "b")
              .select(F.col("u").alias("a"), F.col("v").alias("b")))
    split = (found.sets.where("n > 0").join(found.classes, ["n", "f1", "f2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
             .where("a < b").select(F.explode(F.array("a", "b")).alias("a"), F.col("doc_id").alias("b")))
    joined = graph.components(linked.unionByName(split).where("a != b")).withColumnsRenamed({"node": "rep"})
    out = found.sets.join(found.classes, ["n", "f1", "f2"], "left").join(joined, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"))


def keep_representatives(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One document of each group of linked texts stays (the smallest id); all columns are kept.

    Groups are of texts: rows of one id with unlinked texts are in different groups. Of
    several rows with the staying id one stays, an identified row before one without an id;
    documents without words all stay.

    The verdict is a narrow list of (id, text key), so texts are not shuffled while the list
    is below ``BROADCAST_KEYS`` rows.
    """
    found = join(docs, percent=percent, words=words)
    groups = graph.components(found.links).withColumnRenamed("node", "id")
    linked = found.members.join(groups, "id")
    first = linked.groupBy("component").agg(F.min(F.struct("rep", "f1", "f2", "n")).alias("w"))
    winners = first.select("w.n", "w.f1", "w.f2", F.lit(True).alias("wins"))
    standing = (found.classes.join(linked.select("n", "f1", "f2", F.lit(True).alias("grouped")), ["n", "f1", "f2"], "left")
                .join(winners, ["n", "f1", "f2"], "left")
                .select("n", "f1", "f2", "rep", (F.col("grouped").isNull() | F.col("wins").isNotNull()).alias("stands")))
    rows = found.sets.where("n > 0").groupBy("doc_id", "key", "n", "f1", "f2").agg(F.count("*").alias("c")).join(standing, ["n", "f1", "f2"])
    # one key of the smallest id of a standing set
    least = rows.where(F.col("stands") & (F.col("doc_id") == F.col("rep"))).groupBy("n", "f1", "f2").agg(F.min("key").alias("least"))
    judged = rows.join(least, ["n", "f1", "f2"], "left").select(
        "doc_id", "key", "c", (F.col("stands") & (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("least"))).alias("stays"))
    judged = materialize(judged.where(F.coalesce(~F.col("stays"), F.lit(True)) | (F.col("c") > 1)), "sigtree_verdict")
    out = without_keys(docs, judged.where(F.coalesce(~F.col("stays"), F.lit(True))), NULL_ID)
    again = judged.where("stays")
    if again.isEmpty():
        return out
    # rows that repeat an id and its text
    once = without_keys(out, again, NULL_ID)
    repeated = with_keys(docs, again, NULL_ID)
    one = repeated.groupBy(F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key")).agg(F.first(F.struct(*map(quoted, docs.columns))).alias("_row"))
    return once.unionByName(one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
