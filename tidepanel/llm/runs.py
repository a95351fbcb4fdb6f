"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period ``q``, at least
``max(MIN_LENGTH, MIN_POWER * q)`` words long, that no neighbouring word extends.

1. The words of a few texts get numbers, and Re-Pair turns the sequences into a grammar of
   binary rules. It works in rounds: all pairs of neighbours that occur at least twice are
   replaced, the more frequent pair first where two overlap, until no pair repeats; what
   is left of a text is then folded pairwise into one root. Repeated passages, and copies
   among the texts, share their rules.
2. Every place between two words lies on the boundary of exactly one rule of the
   derivation. For each rule the runs that cross its boundary are computed once, on its
   first occurrence: such a run, ``MIN_POWER >= 4`` periods long, covers two periods on
   one side, so only periods that repeat right before or right behind the boundary are
   extended, by comparing words, to both sides within the rule; multiples of a period that
   explains those words already are not.
3. The runs of a rule are translated to all its places in the derivation. A whole run
   appears at the lowest rule that contains it; pieces of it, found at rules below,
   have the same period and lie inside, so merging leaves the maximal intervals.

All comparisons are on word numbers that stand for equal words; no hashes are used.
Texts go through in groups of about ``CHUNK_WORDS`` words (a longer text is a group of its
own), so memory follows the longest text, not the table.

Defined results: a null or empty text has no words, no runs and four nulls; a null id gets
no planted repetition; repeated rows get equal rows; an empty table gives no rows; texts
are read whole; only the id and text columns are read, so clashing extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_POWER = 6, 4
CHUNK_WORDS = 1 << 18
TESTS = 1 << 20  # (rule, period) tests in one array
STEPS = 4  # words compared for all tests together before the few that go on are extended alone

SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs array<struct<start: long, length: long, period: long>>, runs_sha256 string, collapsed_sha256 string")


def planted(words: list, doc_id: int | None) -> list:
    """The words with the repetition that a tenth of the ids get."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[:n - a]


# ---------------------------------------------------------------- grammar
def _scramble(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _select(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of pairs to replace: higher ranks first, no two of them overlapping.

    ``at`` are the places of pairs in order. Neighbouring places overlap; of equal pairs
    in a row (one symbol repeated) every second one can be taken.
    """
    near = np.diff(at) == 1
    same = near & (rank[1:] == rank[:-1])
    if same.any():
        first = np.concatenate([[True], ~same])
        start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - start) % 2 == 0
        at, rank = at[keep], rank[keep]
    taken = []
    while len(at):
        near = np.diff(at) == 1
        none = np.full(1, -1)
        left = np.concatenate([none, np.where(near, rank[:-1], -1)])
        right = np.concatenate([np.where(near, rank[1:], -1), none])
        top = (rank > left) & (rank > right)
        taken.append(at[top])
        free = ~top
        free[1:] &= ~(near & top[:-1])
        free[:-1] &= ~(near & top[1:])
        at, rank = at[free], rank[free]
    return np.concatenate(taken) if taken else at


def grammar(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rules and derivation of sequences of word numbers.

    ``words`` are the sequences behind each other, ``owner`` (ascending) tells them apart.
    Returns, per rule, the number of words of its left side and of both sides and the first
    word of one occurrence, and the derivation: the rule and the first word of every inner
    node, all sequences together.
    """
    symbol = words.astype(np.int64)
    names = int(symbol.max()) + 1 if len(symbol) else 0
    base = names
    start = np.arange(len(symbol))
    end_of = np.append(start[1:], len(symbol))  # one behind the last word of each symbol
    whose = owner
    changed = np.ones(len(symbol), dtype=bool)  # symbols whose pairs may have become frequent
    lefts, sizes, firsts, node, place = [], [], [], [], []

    def replace(at: np.ndarray, rule: np.ndarray) -> None:
        nonlocal symbol, start, end_of, whose, changed
        _, first = np.unique(rule, return_index=True)
        firsts.append(start[at[first]])
        lefts.append(start[at[first] + 1] - start[at[first]])
        sizes.append(end_of[at[first] + 1] - start[at[first]])
        node.append(rule - base)
        place.append(start[at])
        symbol = symbol.copy()
        symbol[at] = rule
        end_of = end_of.copy()
        end_of[at] = end_of[at + 1]
        new = np.zeros(len(symbol), dtype=bool)
        new[at] = True
        stay = np.ones(len(symbol), dtype=bool)
        stay[at + 1] = False
        symbol, start, end_of, whose, changed = symbol[stay], start[stay], end_of[stay], whose[stay], new[stay]

    while len(symbol) > 1:
        # a pair of two old symbols that did not repeat before does not repeat now
        at = np.nonzero((whose[1:] == whose[:-1]) & (changed[1:] | changed[:-1]))[0]
        key = symbol[at] << 32 | symbol[at + 1]
        pairs, code, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[code] > 1
        if not again.any():
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((_scramble(pairs), count))] = np.arange(len(pairs))
        at, code = at[again], code[again]
        take = np.sort(_select(at, rank[code]))
        _, rule = np.unique(code[np.searchsorted(at, take)], return_inverse=True)
        replace(take, names + rule)
        names += int(rule.max()) + 1
    while len(symbol) > 1:
        first = np.searchsorted(whose, whose)
        at = np.nonzero((np.arange(len(whose)) - first) % 2 == 0)[0]
        at = at[at + 1 < len(whose)]
        at = at[whose[at] == whose[at + 1]]
        if not len(at):
            break
        replace(at, names + np.arange(len(at)))
        names += len(at)
    if not node:
        return (np.empty(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in (lefts, sizes, firsts, node, place))


# ---------------------------------------------------------------- runs of the rules
def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number ``counts`` times, beside 1, 2, ... ``counts``."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(1, len(row) + 1) - np.repeat(np.cumsum(counts) - counts, counts)


def _reach(words: np.ndarray, at: np.ndarray, q: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """How many of the places ``at, at + step, ...`` before ``end`` hold the word ``q`` later."""
    n = np.zeros(len(at), np.int64)
    on = np.nonzero(at != end)[0]
    for _ in range(STEPS):
        here = at[on] + step * n[on]
        on = on[words[here] == words[here + q[on]]]
        n[on] += 1
        on = on[at[on] + step * n[on] != end[on]]
    for i in on.tolist():  # the few long ones, in growing blocks
        a, d, room, block = int(at[i]), int(q[i]), abs(int(end[i] - at[i])), 64
        done = int(n[i])
        while done < room:
            m = min(block, room - done)
            lo = a + done if step > 0 else a - done - m + 1
            same = words[lo:lo + m] == words[lo + d:lo + d + m]
            if not same.all():
                done += int(np.argmin(same if step > 0 else same[::-1]))
                break
            done += m
            block *= 2
        n[i] = done
    return n


def boundary_runs(words: np.ndarray, left: np.ndarray, size: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Runs across the boundary of each rule: ``rule, start, end`` (words of the rule), ``period``."""
    found = []
    big = np.nonzero(size >= MIN_LENGTH)[0]
    for side in (0, 1):
        most = np.minimum((left if side == 0 else size - left)[big] // 2, size[big] // MIN_POWER)
        some = most > 0
        rules, most = big[some], most[some]
        cuts = np.searchsorted(np.cumsum(most), np.arange(0, int(most.sum()), TESTS), side="left")
        for lo, hi in zip(cuts, np.append(cuts[1:], len(rules)), strict=True):
            if lo == hi:
                continue
            row, q = _ragged(most[lo:hi])
            rule = rules[lo:hi][row]
            bound = first[rule] + left[rule]
            # two equal periods right before, or right behind, the boundary
            for j in range(1, STEPS + 1):
                if not len(q):
                    break
                near = np.minimum(j, q)  # a period has q words
                x = bound - near - q if side == 0 else bound + near - 1
                ok = words[x] == words[x + q]
                rule, q, bound = rule[ok], q[ok], bound[ok]
            while len(q):  # the smallest period of each rule, then what its run does not explain
                top = np.concatenate([[True], rule[1:] != rule[:-1]])
                r, d, mid = rule[top], q[top], bound[top]
                a, b = first[r], first[r] + size[r]
                at = mid - d - 1 if side == 0 else mid
                start = at - _reach(words, at, d, a - 1, -1) + 1
                end = at + _reach(words, at, d, b - d, 1) + d
                ok = (end - start >= np.maximum(MIN_LENGTH, MIN_POWER * d)) & (start < mid) & (end > mid)
                found.append(np.stack([r, start - a, end - a, d])[:, ok])
                own = np.cumsum(top) - 1
                covered = (mid - start if side == 0 else end - mid)[own]
                rest = ~top & ((q % d[own] != 0) | (2 * q > covered))
                rule, q, bound = rule[rest], q[rest], bound[rest]
    runs = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
    return _smallest(runs)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Without repeats, and without runs that a run of the same rule and a smaller period covers."""
    runs = np.unique(runs, axis=1)
    order = np.lexsort((runs[3], runs[0]))
    keep, rule, kept = [], -1, []
    for i in order.tolist():
        r, a, b, _ = runs[:, i].tolist()
        if r != rule:
            rule, kept = r, []
        if not any(x <= a and b <= y for x, y in kept):
            kept.append((a, b))
            keep.append(i)
    return runs[:, keep]


def all_runs(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``owner, start, end, period`` (places in ``words``) of every run, by owner, start and period."""
    if len(words) < MIN_LENGTH:
        return np.empty((4, 0), np.int64)
    left, size, first, node, place = grammar(words, owner)
    rule, start, end, period = boundary_runs(words, left, size, first)
    # to every place of the rules in the derivation
    per = np.bincount(rule, minlength=len(left))
    offset = np.cumsum(per) - per
    on = per[node] > 0
    row, k = _ragged(per[node[on]])
    own = offset[node[on][row]] + k - 1
    at = place[on][row]
    start, end, period = at + start[own], at + end[own], period[own]
    who = owner[start]
    # pieces lie inside the whole run of their period
    order = np.lexsort((-end, start, period, who))
    who, start, end, period = who[order], start[order], end[order], period[order]
    fresh = np.ones(len(who), dtype=bool)
    fresh[1:] = (who[1:] != who[:-1]) | (period[1:] != period[:-1])
    shift = np.cumsum(fresh) * (len(words) + 1)
    high = np.maximum.accumulate(end + shift)
    fresh[1:] |= (end + shift)[1:] > high[:-1]
    out = np.stack([who, start, end, period])[:, fresh]
    return out[:, np.lexsort((out[3], out[1], out[0]))]


# ---------------------------------------------------------------- documents
def describe(texts: list[list[bytes]]) -> Iterator[tuple]:
    """Per text: runs ``(start, length, period)``, their digest, the collapsed text's digest."""
    flat = list(itertools.chain.from_iterable(texts))
    numbers = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    words = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    cuts = np.cumsum([0, *map(len, texts)])
    who, start, end, period = all_runs(words, np.repeat(np.arange(len(texts)), np.diff(cuts)))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    dropped = np.cumsum(change) > 0
    ends = np.searchsorted(who, np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        own = slice(ends[i], ends[i + 1])
        a = int(cuts[i])
        runs = list(zip((start[own] - a).tolist(), (end[own] - start[own]).tolist(), period[own].tolist(), strict=True))
        if runs:
            t = [w for w, gone in zip(t, dropped[a:a + len(t)].tolist(), strict=True) if not gone]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        yield runs, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(t)).hexdigest()


def _detect(batches: Iterator):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def emit(ids, texts):
        rows = []
        for i, t, (runs, mark, rest) in zip(ids, texts, describe(texts), strict=True):
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            s, n, q = best or (None, None, None)
            rows.append((i, len(t), len(runs), s, n, q, best and 1000 * n // q, [dict(start=x, length=y, period=z) for x, y, z in runs], mark, rest))
        types = [pa.int64()] * 7 + [kind, pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        ids, texts, held = [], [], 0
        for i, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
            ids.append(i.as_py())
            # bytes.split() parts at \x20 and \x09 to \x0D, as the word pattern does
            texts.append(planted((text.as_py() or b"").split(), ids[-1]))
            held += len(texts[-1])
            if held >= CHUNK_WORDS:
                yield emit(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield emit(ids, texts)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its longest run, all runs, and the digests of the list and of
    the text without the repetitions (columns of ``SCHEMA``)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_detect, SCHEMA)
