"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space collapsed, and reduced to the set of its hashed
n-grams of ``SHORTEST`` to ``LONGEST`` characters (spaces mark the ends of words). On labelled
documents outside the held-out fold

1. the documents of each class that hold an n-gram are counted; with ``p`` of ``P`` toxic and
   ``q`` of ``Q`` other documents its log-count ratio is ``log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2))``;
2. the ``FEATURES`` n-grams whose counts tell the classes apart best (likelihood ratio
   statistic, at least ``MIN_DOCS`` documents) are the features; a present feature has its
   ratio as its value;
3. a logistic regression with L2 penalty is fitted on these values.

The fit uses at most about ``MAX_FIT_DOCS`` documents of a class, drawn by hash of id and text;
each counts as many times as documents it stands for, so the class shares are those of all
labelled documents. What reaches the driver is bounded by the sample: ``FEATURES`` rows of
counts and the feature numbers of the drawn documents. Every document is then scored over
its whole text, in chunks of ``CHUNK_CHARS``.

Defined results: a null or empty text has no n-grams and gets the score of the intercept;
a document labelled more than once is toxic if any label says so, a null label is none,
null ids are never learned from; repeated rows count once in the fit and get equal scores;
without toxic (other) training documents every score is 0 (1); an empty table gives no
rows; only the named columns are read, so clashing extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.ppm import held_out
from tidepanel.llm.shingle import collected
from tidepanel.llm.text import text_key
from tidepanel.session import materialize

SHORTEST, LONGEST = 3, 6
HASH_BITS = 20
FEATURES = 4000
MIN_DOCS = 3
MAX_FIT_DOCS = 4000
PENALTY = 1.0
ITERATIONS = 300
CHUNK_CHARS = 1 << 18


@dataclass
class Model:
    """``feature``: hash bucket -> feature number or -1; ``weight``: its share of the log odds."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float


# ---------------------------------------------------------------- n-grams
def _hits(texts: list[str], table: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, bucket)`` of the n-grams of each length, or ``(text, feature)`` of those in a table."""
    cuts = np.cumsum([0, *map(len, texts)])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, min(LONGEST, len(code)) + 1):
        h = h[:len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:] + np.uint64(1)
        if n < SHORTEST:
            continue
        bucket = (((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        at = np.arange(len(bucket))
        if table is not None:
            bucket = table[bucket]
            at = np.nonzero(bucket >= 0)[0]
            bucket = bucket[at].astype(np.int64)
        text = np.searchsorted(cuts, at, side="right") - 1
        inside = at + n <= cuts[text + 1]
        yield text[inside], bucket[inside]


def _sets(texts: list[str], table: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``(text, bucket or feature)`` of some texts, in order."""
    keys = [text * width + x for text, x in _hits(texts, table)]
    found = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return found // width, found % width


def plain(text: str | None) -> str:
    words = (text or "").lower().split()
    return f" {' '.join(words)} " if words else ""


def _pieces(text: str) -> list[str]:
    """Parts of a long text that hold each of its n-grams."""
    return [text[a:a + CHUNK_CHARS + LONGEST - 1] for a in range(0, max(1, len(text) - LONGEST + 1), CHUNK_CHARS)]


def _chunks(column) -> Iterator[tuple[np.ndarray, list[str]]]:
    """``(text numbers, their plain texts)`` of bounded size; a long text comes in pieces."""
    rows, held, size = [], [], 0
    for i, value in enumerate(column):
        for piece in _pieces(plain(value.as_py())):
            rows.append(i)
            held.append(piece)
            size += len(piece)
            if size >= CHUNK_CHARS:
                yield np.array(rows), held
                rows, held, size = [], [], 0
    if held:
        yield np.array(rows), held


def present(column, table: np.ndarray | None = None, width: int = 1 << HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``(text number, bucket or feature)`` of a column of texts."""
    keys = []
    for rows, texts in _chunks(column):
        text, x = _sets(texts, table, width)
        keys.append(np.unique(rows[text] * width + x))
    found = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return found // width, found % width


# ---------------------------------------------------------------- fit
def _count(batches: Iterator):
    """(bucket, p, q): documents of a task that hold an n-gram, by class."""
    import pyarrow as pa

    total = np.zeros((2, 1 << HASH_BITS), np.int64)
    for batch in batches:
        toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        for a in range(0, len(toxic), 64):
            text, bucket = present(batch.column(0).slice(a, 64))
            for c in (0, 1):
                total[c] += np.bincount(bucket[toxic[a:][text] == c], minlength=total.shape[1])
    used = np.nonzero(total.any(0))[0]
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1][used]), pa.array(total[0][used])], names=["bucket", "p", "q"])


def _likelihood_ratio(p: Column, q: Column, many: int, other: int) -> Column:
    """How far the counts are from equal shares in both classes (G statistic)."""
    n, held = float(many + other), p + q
    cells = [(p, held * many / n), (q, held * other / n), (many - p, (n - held) * many / n), (other - q, (n - held) * other / n)]
    return sum((F.when(a > 0, a * F.log(a / e)).otherwise(0.0) for a, e in cells), F.lit(0.0))


def _rows_of(table):
    """(toxic, features): feature numbers of each document."""
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            text, x = present(batch.column(0), table.value, len(table.value))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32)))],
                                             names=["toxic", "features"])
    return run


def logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, importance: np.ndarray, width: int,
             penalty: float = PENALTY, iterations: int = ITERATIONS) -> np.ndarray:
    """Coefficients of a sparse logistic regression; the last column is not penalised.

    Accelerated gradient steps whose size comes from the largest eigenvalue.
    """
    def forward(w):
        return np.bincount(row, weights=value * w[col], minlength=len(y))

    def back(z):
        return np.bincount(col, weights=value * z[row], minlength=width)

    v, top = np.ones(width), 1.0
    for _ in range(30):
        v = back(importance * forward(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    penalties = np.full(width, penalty)
    penalties[-1] = 0.0
    size = 1.0 / (0.26 * top + penalty)
    w = ahead = np.zeros(width)
    t = 1.0
    for _ in range(iterations):
        slope = back(importance * (1.0 / (1.0 + np.exp(-forward(ahead))) - y)) + penalties * ahead
        new = ahead - size * slope
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_docs: int = MAX_FIT_DOCS, features: int = FEATURES) -> Model:
    """The classifier, learned from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("key", text_key(F.col("text")))
    marked = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
              .agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic")))
    known = materialize(d.select("doc_id", "key").distinct().join(marked, "doc_id"), "toxicity_labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    many, other = sizes.get(1, 0), sizes.get(0, 0)
    none = np.full(1 << HASH_BITS, -1, np.int16)
    if not many or not other:
        return Model(none, np.empty(0), np.inf if many else -np.inf)
    share = F.when(F.col("toxic") == 1, min(1.0, max_docs / many)).otherwise(min(1.0, max_docs / other))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 20)) / float(1 << 20) < share)  # about 2 * max_docs rows
    sample = (d.join(F.broadcast(drawn), ["doc_id", "key"]).groupBy("doc_id", "key", "toxic").agg(F.any_value("text").alias("text"))
              .select("text", "toxic"))
    sample = materialize(sample, "toxicity_sample")
    drawn_sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p_all, q_all = drawn_sizes.get(1, 0), drawn_sizes.get(0, 0)
    counted = sample.mapInArrow(_count, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    best = (counted.where(F.col("p") + F.col("q") >= MIN_DOCS)
            .withColumn("g", _likelihood_ratio(F.col("p"), F.col("q"), p_all, q_all)).where("g > 0")
            .orderBy(F.desc("g"), "bucket").limit(features))
    got = collected(best.select("bucket", "p", "q"))
    ratio = np.log((got["p"] + 1) / (p_all + 2)) - np.log((got["q"] + 1) / (q_all + 2))
    none[got["bucket"]] = np.arange(len(ratio))
    rows = sample.mapInArrow(_rows_of(spark.sparkContext.broadcast(none)), "toxic int, features array<int>").toArrow()
    y = rows.column("toxic").to_numpy().astype(float)
    lists = rows.column("features").combine_chunks()
    sizes_of = lists.value_lengths().to_numpy(zero_copy_only=False)
    col = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), sizes_of)
    importance = np.where(y == 1, many / max(p_all, 1), other / max(q_all, 1))
    importance *= len(y) / importance.sum()
    width = len(ratio) + 1  # and the intercept
    w = logistic(np.concatenate([row, np.arange(len(y))]), np.concatenate([col, np.full(len(y), width - 1)]),
                 np.concatenate([ratio[col], np.ones(len(y))]), y, importance, width)
    return Model(none, w[:-1] * ratio, float(w[-1]))


# ---------------------------------------------------------------- scores
def _scorer(shared):
    def run(batches: Iterator):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            text, x = present(batch.column(1), model.feature, 1 << HASH_BITS)
            odds = np.bincount(text, weights=model.weight[x], minlength=batch.num_rows) + model.intercept
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-odds)))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = d.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
