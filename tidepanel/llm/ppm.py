"""Language identification by prediction by partial matching over bytes.

For every language a variable-order context tree (up to three bytes of context) is counted
on a bounded sample of labelled documents and frozen. The code length of a byte follows
the tree with escapes (method C): in a context seen ``n`` times with ``d`` distinct
followers, a follower seen ``c`` times costs ``c / (n + d)``, anything else ``d / (n + d)``
times its share in the next shorter context among the bytes not yet excluded; below the
empty context every byte (case-folded, digits as one) is equally likely. The statistics are
frozen, so a follower's code length and a context's escape are computed once and kept in
sorted arrays: nothing is stored for followers that were not seen. A batch is reduced to
its distinct four-byte grams, which each language codes once. The language with the
shortest total code length wins.

Every ``lang`` value with a text outside the held-out fold is learned, however rare, with
all its contexts and bytes.

``MAX_FIT_DOCS`` documents per language (chosen by hash of id and text, so copies are drawn one by one) bound the fit, and its
distinct grams the tables, at 12 B for each seen follower and context of each order. Languages are learned, broadcast and
scored in blocks of ``BLOCK_LANGUAGES``: a worker holds one block and ``BUFFER_BYTES`` of
texts at a time and keeps the best code length and the sum for the score.

Defined results: a null text or one without any letter is ``und`` with score 0, and so is
every text if nothing was learned; a text's repeats get equal rows; texts are scored
whole, in chunks of bounded memory; an empty table gives no rows; only the named columns
are read. Ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidepanel.llm.shingle import collected, utf8
from tidepanel.session import materialize

ORDER = 3
PAD = 32  # the bytes before a text
MAX_FIT_DOCS = 1500
BLOCK_LANGUAGES = 16
FOLDS = 5
CHUNK_BYTES = 1 << 20
BUFFER_BYTES = 32 << 20  # of texts scored with one block before the next is loaded
RAW_BITS = 8.0  # bits per byte of an uncoded text


@dataclass
class Tree:
    """Context tree of one language: sorted keys with code lengths, an entry per order.

    A key of order k packs k context bytes and, for ``seen``, the follower.
    """

    seen: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    escape: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def code(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of every distinct packed gram, given the ``order`` before it."""
        bits = np.zeros(len(grams))
        left = np.arange(len(grams))  # grams not yet coded
        for k in range(order, -1, -1):
            key = (grams[left] & np.uint32((1 << 8 * (k + 1)) - 1)).astype(np.uint32)
            at, hit = _found(self.seen[k][0], key)
            bits[left[hit]] += self.seen[k][1][at[hit]]
            left, key = left[~hit], key[~hit]
            at, hit = _found(self.escape[k][0], key >> np.uint32(8))
            bits[left[hit]] += self.escape[k][1][at[hit]]
        bits[left] += np.log2(len(ALPHABET))
        return bits


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys`` and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


@dataclass
class Model:
    """Frozen trees of some languages."""

    languages: list[str] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _fold_case() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    lut[9:14] = 32
    lut[48:58] = 48
    return lut


FOLD = _fold_case()
ALPHABET = np.unique(FOLD)


def _count_bytes(batches: Iterator):
    """(lang, gram, n): packed four-byte grams of each sampled document, padded in front."""
    import pyarrow as pa

    for batch in batches:
        langs = batch.column(1).to_pylist()
        off, raw = utf8(batch.column(0))
        raw = FOLD[raw]
        by: dict[str, list[np.ndarray]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(np.concatenate([np.full(ORDER, PAD, np.uint8), raw[off[i]:off[i + 1]]]))
        for lang, texts in by.items():
            grams = [x[:-3].astype(np.uint32) << 24 | x[1:-2].astype(np.uint32) << 16 | x[2:-1].astype(np.uint32) << 8 | x[3:]
                     for x in texts if len(x) > ORDER]
            if grams:
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def tree(grams: np.ndarray, n: np.ndarray) -> Tree:
    """Context tree of one language from its distinct four-byte grams and their counts."""
    out = Tree()
    for order in range(ORDER + 1):
        keys, inverse = np.unique(grams.astype(np.uint32) & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        c = np.bincount(inverse, weights=n, minlength=len(keys))
        # the share of the followers seen here in the next shorter context: they are excluded there
        below = np.exp2(-out.code(keys, order - 1)) if order else np.full(len(keys), 1.0 / len(ALPHABET))
        contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
        t, d, used = (np.bincount(of, weights=w, minlength=len(contexts)) for w in (c, np.ones(len(keys)), below))
        full = d == len(ALPHABET)
        rest = np.maximum(1.0 - used, 1e-12)
        out.seen.append((keys, -np.log2(c / np.where(full, t, t + d)[of]).astype(np.float32)))
        out.escape.append((contexts, np.where(full, 0.0, -np.log2(d / ((t + d) * rest))).astype(np.float32)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = MAX_FIT_DOCS) -> Iterator[Model]:
    """Frozen models of all languages in order, a block at a time, learned from documents outside the held-out fold."""
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                    F.col(id_col).alias("id")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = [(r["lang"], min(1.0, max_docs / r["n"])) for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # one row per language
    if not sizes:
        return
    sizes.sort()
    shares = docs.sparkSession.createDataFrame(sizes, "lang string, share double")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    counted = (d.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("text", "lang").mapInArrow(_count_bytes, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))  # bounded by the sample
    if len(sizes) > BLOCK_LANGUAGES:
        counted = materialize(counted, "ppm_grams")
    for first in range(0, len(sizes), BLOCK_LANGUAGES):
        block = [lang for lang, _ in sizes[first:first + BLOCK_LANGUAGES]]
        grams = collected(counted.where(F.col("lang").isin(block)))
        model = Model()
        for lang in block:
            own = grams["lang"] == lang
            if own.any():
                model.languages.append(lang)
                model.trees.append(tree(grams["gram"][own], grams["n"][own]))
        if model.languages:
            yield model


def code_lengths(model: Model, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Bits of every text (rows) under every language (columns)."""
    total = np.zeros((len(off) - 1, len(model.languages)))
    first = off[:-1][np.diff(off) > 0]
    # chunks of bounded size; a chunk carries the three bytes before it
    for a in range(0, len(raw), CHUNK_BYTES):
        b = min(len(raw), a + CHUNK_BYTES)
        lead = min(a, ORDER)
        lo = np.searchsorted(off, a, side="right") - 1
        hi = np.searchsorted(off, b, side="left")
        cuts = np.clip(off[lo:hi], a, b) - a
        ends = np.append(cuts[1:], b - a)
        starts = first[(first > a - ORDER) & (first < b)]
        s = np.concatenate([np.full(ORDER - lead, PAD, np.uint8), FOLD[raw[a - lead:b]]]).astype(np.uint32)
        c = [s[:-3].copy(), s[1:-2].copy(), s[2:-1].copy()]
        for j in range(ORDER):  # the context of a text's first bytes is padding
            at = starts + j
            at = at[(at >= a) & (at < b)] - a
            for k in range(ORDER - j):
                c[k][at] = PAD
        grams, place = np.unique(c[0] << 24 | c[1] << 16 | c[2] << 8 | s[3:], return_inverse=True)
        for m, language in enumerate(model.trees):
            run = np.concatenate([[0.0], np.cumsum(language.code(grams)[place])])
            total[lo:hi, m] += run[ends] - run[cuts]
    return total


def _has_letter(off: np.ndarray, raw: np.ndarray, texts) -> np.ndarray:
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[65:91] = 1
    ascii_letter[97:123] = 1
    run = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
    found = run[off[1:]] > run[off[:-1]]
    for i in np.nonzero(~found & (np.diff(off) > 0))[0]:
        found[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
    return found


def _scorer(blocks: list, field: str | None):
    def score(batches: list):
        import pyarrow as pa

        sets = []
        for batch in batches:
            texts = batch.column(1) if field is None else batch.column(0).field(field)
            off, raw = utf8(texts)
            n = len(off) - 1
            # best language, its bits, and the sum of 2**-(bits - best) over all languages
            sets.append((off, raw, _has_letter(off, raw, texts), np.full(n, "", dtype=object), np.full(n, np.inf), np.zeros(n)))
        for block in blocks:
            model = block.value
            for off, raw, _, lang, best, total in sets:
                bits = code_lengths(model, off, raw)
                low = bits.min(1)
                lang[low < best] = np.array(model.languages, dtype=object)[bits.argmin(1)[low < best]]
                least = np.minimum(low, best)
                total *= np.exp2(-np.minimum(best - least, 1000.0))
                total += np.exp2(-np.minimum(bits - least[:, None], 1000.0)).sum(1)
                best[:] = least
            if len(blocks) > 1:
                del model
                _forget(block)
        for batch, (off, _, known, lang, best, total) in zip(batches, sets, strict=True):
            known = known & bool(blocks)
            size = np.maximum(np.diff(off), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x if k else "und" for x, k in zip(lang, known, strict=True)], pa.string()),
                 pa.array([float(1.0 / t) if k else 0.0 for t, k in zip(total, known, strict=True)], pa.float64()),
                 pa.array([float(x) if k else None for x, k in zip(best / size, known, strict=True)], pa.float64())],
                names=["kept", "lang_pred", "score", "bits_per_byte"])

    def run(batches: Iterator):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(blocks) <= 1 or size >= BUFFER_BYTES:
                yield from score(held)
                held, size = [], 0
        if held:
            yield from score(held)
    return run


def _forget(block) -> None:
    """Drops a worker's copy of a broadcast value; it is read again from the worker's file."""
    if getattr(block, "_path", None) is not None and hasattr(block, "_value"):
        del block._value


def predict(docs: DataFrame, models: Iterable[Model], keep: Column, text_col: str = "text", field: str | None = None) -> DataFrame:
    """``kept, lang_pred, score, bits_per_byte``: the prediction beside one kept value.

    If the kept value is a struct that holds the text, ``field`` names it there, and the
    text is sent once.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in models]  # one block at a time on the driver
    texts = [] if field else [F.col(text_col).cast("string").alias("_text")]
    d = docs.select(keep.alias("kept"), *texts)
    schema = StructType([d.schema["kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("bits_per_byte", DoubleType())])
    return d.mapInArrow(_scorer(shared, field), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every document."""
    models = fit(docs, id_col, text_col, lang_col)
    return predict(docs, models, F.col(id_col), text_col).select(
        F.col("kept").alias("doc_id"), held_out(F.col("kept")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, max_bits_per_byte: float = RAW_BITS) -> DataFrame:
    """Documents in a learned language, ``lang`` set to it; the columns stay as they are.

    Rejected are ``und`` and texts that no model codes shorter than their raw bytes.
    """
    scored = predict(docs, fit(docs), F.struct(*docs.columns), field="text")
    kept = scored.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= max_bits_per_byte))
    return kept.select(*[F.col("lang_pred" if c == "lang" else f"kept.`{c}`").alias(c) for c in docs.columns])
