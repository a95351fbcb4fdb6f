"""The trees of MLlib's booster, grown from stored bins.

MLlib keeps an object per row and a pair per row and tree; beyond the executors' memory these
go to disk and are read again for every level. Here the rows are stored once, as chunks of bins,
targets and weights. Every level of every tree is one scan of the chunks, in which the tasks sum
``n, Σw, Σw·r, Σw·r²`` by (node, input, bin); the residual ``r`` follows from the bins and the
trees so far, so nothing is kept per row and tree. What is shuffled and collected are sums,
bounded by the nodes of a level and the bins.

Rows, splits and gains are MLlib's: candidate splits come from the rows its seeded sampler takes
from the partitions of ``gbt._stable`` (found from row counts, without dealing the rows), a
split's gain is the variance reduction, the first of equal splits wins, leaves with equal
predictions are merged, and with validation rows training stops at its tolerance. The result is
an MLlib model. Weights and targets must be finite, as there.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.columns import DATE, ID_COLUMNS, SYMBOL, TIME
from tidepanel.session import checkpoint_path, reliable_checkpoint, remove_path

SAMPLE_ROWS = 10_000  # MLlib draws max(this, bins²) rows for the candidate splits
HELD_CELLS = 4_000_000  # (node, input, bin) sums a task holds; a level with more takes several scans
ROWS_PER_TASK = 2_000_000  # of a scan of the stored chunks
DRIVER_SUMS = 64  # tasks whose sums the driver adds itself
EPSILON = 2.0 ** -52
NO_GAIN = -math.inf


@dataclass
class Node:
    """``stats`` are Σw, Σw·r, Σw·r² and n of the node's rows."""

    stats: tuple
    impurity: float
    gain: float = 0.0
    valid: bool = True
    feature: int = -1  # of the values, then of the missing flags
    cut: int = -1  # the last bin that goes left
    children: tuple[Node, Node] | None = None

    @property
    def prediction(self) -> float:
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0


@dataclass
class Grown:
    """A tree for the workers: splits ``(node, input, is flag, cut)`` in the order of the levels, values by node."""

    splits: list = field(default_factory=list)
    values: np.ndarray | None = None  # contribution of each leaf (weight of the tree included)


# ---------------------------------------------------------------- candidate splits
def _positions(spark: SparkSession, counts: dict[int, int], n_parts: int, fraction: float, seed: int) -> list[tuple[int, int]]:
    """The places that ``RDD.sample`` takes from partitions of so many rows."""
    jvm = spark.sparkContext._jvm
    rng = jvm.org.apache.spark.util.random.XORShiftRandom
    seeds = jvm.java.util.Random(rng(seed).nextInt())
    out = []
    for p in range(n_parts):
        own, rows = rng(0), counts.get(p, 0)
        own.setSeed(seeds.nextLong())
        if fraction <= 0.4:  # Spark draws gaps up to here, rows beyond
            lnq, at = math.log1p(-fraction), 0
            while rows:
                at += int(math.log(max(own.nextDouble(), 5e-11)) / lnq)
                if at >= rows:
                    break
                out.append((p, at))
                at += 1
        else:
            out += [(p, i) for i in range(rows) if own.nextDouble() <= fraction]
    return out


def _sampled(data: DataFrame, n_parts: int, max_bins: int, seed: int) -> tuple[DataFrame, float, float, int]:
    """The rows of MLlib's sample, its share of the rows, the weight and the number of all rows.

    A row's partition follows from its keys, its place there from the rows of earlier days, of
    earlier times of the day, and from its rank among the rest; only days and times that hold
    a sampled place are looked at further.
    """
    spark = data.sparkSession
    data = data.withColumn("_p", F.pmod(F.hash(SYMBOL, DATE), F.lit(n_parts)))
    days = reliable_checkpoint(data.groupBy("_p", DATE).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_sw")))
    parts = days.groupBy("_p").agg(F.sum("_n").alias("n"), F.sum("_sw").alias("w")).collect()  # one per gbt.ROWS_PER_PARTITION rows
    total, mass = sum(r["n"] for r in parts), math.fsum(r["w"] for r in parts)
    if not total:
        raise ValueError("boosted trees need rows to fit on")
    wanted = max(min(max_bins, total) ** 2, SAMPLE_ROWS)
    if wanted >= total:
        return data, 1.0, mass, total
    fraction = wanted / total
    places = _positions(spark, {r["_p"]: r["n"] for r in parts}, n_parts, fraction, seed)
    before = Window.partitionBy("_p").orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_p", F.col(DATE).alias("_day"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    places = spark.createDataFrame(places, "_p int, _at long")
    days = _cells(days.join(F.broadcast(places), "_p"), "_p", "_day")
    at_day = (F.col("_p") == F.col("_p_of")) & F.col(DATE).eqNullSafe(F.col("_day_of"))
    times = data.select("_p", DATE, TIME).join(F.broadcast(days), at_day).groupBy("_p", F.col(DATE).alias("_day"), F.col(TIME).alias("_time"))
    times = times.agg(F.count(F.lit(1)).alias("_n"), F.first("_places").alias("_places"))
    before = Window.partitionBy("_p", "_day").orderBy("_time").rowsBetween(Window.unboundedPreceding, -1)
    times = times.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")).select("*", F.explode("_places").alias("_at"))
    times = _cells(times, "_p", "_day", "_time")
    near = data.join(F.broadcast(times), at_day & F.col(TIME).eqNullSafe(F.col("_time_of")))
    rank = F.row_number().over(Window.partitionBy("_p", DATE, TIME).orderBy(SYMBOL)) - 1
    return near.withColumn("_rank", rank.cast("long")).where(F.array_contains("_places", F.col("_rank"))), fraction, mass, total


def _cells(df: DataFrame, *keys: str) -> DataFrame:
    """The groups of rows that hold sampled places, with the places inside them; stored, at most one per sampled row."""
    here = df.where((F.col("_at") >= F.col("_off")) & (F.col("_at") < F.col("_off") + F.col("_n")))
    places = F.collect_list((F.col("_at") - F.col("_off")).cast("long")).alias("_places")
    return reliable_checkpoint(here.groupBy(*keys).agg(places).withColumnsRenamed({k: f"{k}_of" for k in keys}))


def thresholds(values: np.ndarray, weights: np.ndarray, max_splits: int, expected: float) -> np.ndarray:
    """Candidate splits of one input from its sampled values: about equal weight between them.

    ``expected`` is the weight of a sample of this share; what the nonzero values lack of it counts as zeros.
    """
    own = values != 0
    distinct, at = np.unique(values[own], return_inverse=True)
    mass = np.bincount(at, weights=weights[own], minlength=len(distinct))
    if not len(distinct):
        return np.empty(0)
    lack = expected - float(mass.sum())
    if lack > EPSILON * int(own.sum()) * 100:
        k = int(np.searchsorted(distinct, 0.0))
        distinct, mass = np.insert(distinct, k, 0.0), np.insert(mass, k, lack)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middle) <= max_splits:
        return middle
    stride = expected / (max_splits + 1)
    out, current, target = [], mass[0], stride
    for i in range(1, len(distinct)):
        previous, current = current, current + mass[i]
        if abs(previous - target) < abs(current - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


# ---------------------------------------------------------------- the stored chunks
def _binned(cuts: list[np.ndarray], k: int, kind: str, sentinel: float):
    """Rows -> chunks: the codes ``2·bin + bin of the missing flag`` input by input, targets and weights, compressed."""
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k + 2)]
            y, w = cols[k], cols[k + 1]
            if not np.isfinite(y).all():
                raise ValueError("boosted trees need finite targets")
            if not (np.isfinite(w) & (w >= 0)).all():
                raise ValueError("boosted trees need finite weights that are not negative")
            codes = np.empty((k, len(y)), kind)
            for f in range(k):
                x = cols[f]
                missing = np.isnan(x)
                if np.isinf(x).any():
                    raise ValueError("boosted trees need finite inputs")
                codes[f] = 2 * np.searchsorted(cuts[f], np.where(missing, sentinel, x))
                if len(cuts[k + f]):  # a flag has one threshold at most
                    codes[f] += missing
            chunk = pa.compress(codes.tobytes() + y.astype(float).tobytes() + w.astype(float).tobytes(), "lz4", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), pa.array([chunk], pa.binary())], names=["n", "chunk"])
    return run


def _opened(record: tuple, k: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow as pa

    n, chunk = record
    cells = k * n * np.dtype(kind).itemsize
    raw = pa.decompress(chunk, cells + 16 * n, "lz4", asbytes=True)
    return np.frombuffer(raw, kind, k * n).reshape(k, n), np.frombuffer(raw, float, n, cells), np.frombuffer(raw, float, n, cells + 8 * n)


# ---------------------------------------------------------------- scans
def _node_of(codes: np.ndarray, splits: list, kind) -> np.ndarray:
    """The node that each row reaches; the root is 1, children of ``j`` are ``2j`` and ``2j + 1``."""
    node = np.ones(codes.shape[1], kind)
    for j, f, flag, cut in splits:
        right = codes[f] & 1 if flag else codes[f] > 2 * cut + 1
        node += (node == j) * (right.astype(kind) + kind(j))
    return node


def _fitted(codes: np.ndarray, trees: list[Grown], kind) -> np.ndarray:
    out = np.zeros(codes.shape[1])
    for t in trees:
        out += t.values[_node_of(codes, t.splits, kind)]
    return out


def _histograms(trees: list[Grown], splits: list, active: list[int], k: int, n_codes: int, codes_kind: str, kind):
    """A task's ``n, Σw, Σw·r, Σw·r²`` by input, node of ``active`` and code."""
    def run(records: Iterator):
        size = len(active) * n_codes
        held = np.zeros((k, 4, size))
        slot = np.full(max(active) + 2, -1, np.int64)  # the last stands for all later nodes
        slot[active] = np.arange(len(active))
        for record in records:
            codes, y, w = _opened(record, k, codes_kind)
            at = slot[np.minimum(_node_of(codes, splits, kind), len(slot) - 1)]
            own = at >= 0
            if not own.all():
                codes, y, w, at = np.ascontiguousarray(codes[:, own]), y[own], w[own], at[own]
            if not len(at):
                continue
            r = 2.0 * (y - _fitted(codes, trees, kind)) if trees else y
            wr = w * r
            wrr = wr * r
            at *= n_codes
            for f in range(k):
                i = at + codes[f]
                held[f, 0] += np.bincount(i, minlength=size)
                held[f, 1] += np.bincount(i, weights=w, minlength=size)
                held[f, 2] += np.bincount(i, weights=wr, minlength=size)
                held[f, 3] += np.bincount(i, weights=wrr, minlength=size)
        yield held
    return run


def _errors(trees: list[Grown], k: int, codes_kind: str, kind):
    def run(records: Iterator):
        sums = np.zeros(2)
        for record in records:
            codes, y, w = _opened(record, k, codes_kind)
            miss = y - _fitted(codes, trees, kind)
            sums += (miss * miss * w).sum(), w.sum()
        yield sums
    return run


# ---------------------------------------------------------------- growing
def _impurity(w, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0, 0.0, (q - s * s / w) / w)


def _best_split(bins: list[np.ndarray], node: Node | None) -> Node:
    """The node with its best split; ``bins[input]`` has a row ``n, Σw, Σw·r, Σw·r²`` per bin."""
    best = None
    for f, h in enumerate(bins):
        if len(h) < 2:
            continue
        total = np.cumsum(h, axis=0)
        left, right = total[:-1], total[-1] - total[:-1]
        if node is None:
            n, w, s, q = left[0] + right[0]
            node = Node((w, s, q, n), float(_impurity(w, s, q)))
        mass = left[:, 1] + right[:, 1]
        lower, upper = _impurity(*left[:, 1:].T), _impurity(*right[:, 1:].T)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = node.impurity - left[:, 1] / mass * lower - right[:, 1] / mass * upper
        gain = np.where((left[:, 0] >= 1) & (right[:, 0] >= 1) & (gain >= 0), gain, NO_GAIN)
        cut = int(np.argmax(gain))
        if best is None or gain[cut] > best[0]:
            sides = [Node((*h[1:], h[0]), float(i)) for h, i in ((left[cut].tolist(), lower[cut]), (right[cut].tolist(), upper[cut]))]
            best = float(gain[cut]), f, cut, sides
    if best is None:  # no input can be split
        n, w, s, q = bins[0].sum(axis=0).tolist()
        node = node or Node((w, s, q, n), float(_impurity(w, s, q)))
        node.valid = False
        return node
    node.gain, node.valid = best[0], best[0] > NO_GAIN
    if node.gain > 0:
        node.feature, node.cut, node.children = best[1], best[2], tuple(best[3])
    return node


def _merged(node: Node) -> Node:
    """Sibling leaves with one prediction become a leaf."""
    if node.children:
        node.children = tuple(_merged(c) for c in node.children)
        if not any(c.children for c in node.children) and node.children[0].prediction == node.children[1].prediction:
            node.children = None
    return node


def _added(sums: RDD) -> np.ndarray:
    return sums.reduce(np.add) if sums.getNumPartitions() <= DRIVER_SUMS else sums.treeReduce(np.add)


class _Booster:
    def __init__(self, rows: RDD, cuts: list[np.ndarray], max_depth: int, codes_kind: str):
        self.rows, self.cuts, self.depth, self.codes_kind = rows, cuts, max_depth, codes_kind
        self.k = len(cuts) // 2
        self.n_codes = 2 * (max(len(c) for c in cuts[:self.k]) + 1)
        self.kind = np.uint8 if max_depth < 7 else np.int32

    def level(self, trees: list[Grown], splits: list, active: list[int]) -> dict[int, list[np.ndarray]]:
        """Sums by input and bin of every active node."""
        scan = _histograms(trees, splits, active, self.k, self.n_codes, self.codes_kind, self.kind)
        held = _added(self.rows.mapPartitions(scan)).reshape(self.k, 4, len(active), self.n_codes // 2, 2)
        held = held.transpose(0, 2, 3, 4, 1)
        out = {}
        for i, j in enumerate(active):
            values = [held[f, i].sum(axis=1)[:len(self.cuts[f]) + 1] for f in range(self.k)]
            flags = [held[f, i].sum(axis=0)[:len(self.cuts[self.k + f]) + 1] for f in range(self.k)]
            out[j] = values + flags
        return out

    def tree(self, trees: list[Grown]) -> tuple[Node, list]:
        nodes: dict[int, Node | None] = {1: None}
        splits, active = [], [1]
        most = max(1, HELD_CELLS // (self.k * self.n_codes))
        for depth in range(self.depth):
            found = {}
            for at in range(0, len(active), most):
                found |= self.level(trees, splits, active[at:at + most])
            later = []
            for j in active:
                node = nodes[j] = _best_split(found[j], nodes[j])
                if not node.children:
                    continue
                splits.append((j, node.feature % self.k, node.feature >= self.k, node.cut))
                for i, child in ((2 * j, node.children[0]), (2 * j + 1, node.children[1])):
                    nodes[i] = child
                    if depth + 1 < self.depth and abs(child.impurity) >= EPSILON:
                        later.append(i)
            active = later
            if not active:
                break
        if self.depth == 0:
            raise ValueError("boosted trees need a depth of 1 at least")
        return nodes[1], splits

    def grown(self, root: Node, splits: list, weight: float) -> Grown:
        """For the workers, with the splits that are left after siblings were merged."""
        values = np.zeros(2 ** (self.depth + 1))
        kept = []

        def walk(node: Node, j: int):
            if node.children:
                kept.append(j)
                walk(node.children[0], 2 * j)
                walk(node.children[1], 2 * j + 1)
            else:
                values[j] = node.prediction * weight

        walk(root, 1)
        return Grown([s for s in splits if s[0] in kept], values)

    def error(self, rows: RDD, trees: list[Grown]) -> float:
        err, mass = _added(rows.mapPartitions(_errors(trees, self.k, self.codes_kind, self.kind)))
        if not mass:
            raise ValueError("the validation rows have no weight")
        return float(err / mass)


def _model(spark: SparkSession, trees: list[Node], weights: list[float], cuts: list[np.ndarray]) -> GBTRegressionModel:
    sc = spark.sparkContext
    jvm, new_array = sc._jvm, sc._gateway.new_array
    ml = jvm.org.apache.spark.ml

    def calculator(node: Node):
        stats = new_array(jvm.double, 3)
        for i in range(3):
            stats[i] = float(node.stats[i])
        return jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, int(node.stats[3]))

    def build(node: Node):
        if not node.children:
            return ml.tree.LeafNode(float(node.prediction), float(node.impurity if node.valid else -1.0), calculator(node))
        split = ml.tree.ContinuousSplit(node.feature, float(cuts[node.feature][node.cut]))
        left, right = (build(c) for c in node.children)
        return ml.tree.InternalNode(float(node.prediction), float(node.impurity), float(node.gain), left, right, split, calculator(node))

    uid = f"GBTRegressor_{uuid.uuid4().hex[-12:]}"
    own = new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    mass = new_array(jvm.double, len(trees))
    for i, (root, weight) in enumerate(zip(trees, weights, strict=True)):
        own[i] = ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[-12:]}", build(root), len(cuts))
        mass[i] = float(weight)
    return GBTRegressionModel(ml.regression.GBTRegressionModel(uid, own, mass, len(cuts)))


def fits(params, *frames: DataFrame) -> bool:
    """Whether the trees can be grown here: whole rows and inputs in every tree, keyed rows."""
    return (params.subsampling_rate == 1.0 and params.feature_subset == "all" and 1 <= params.max_depth < 30 and params.max_bins <= 1 << 14
            and all(c in df.columns for c in ID_COLUMNS for df in frames))


def grow(train: DataFrame, features: list[str], params, target: str, weight: str, valid: DataFrame | None, n_parts: int, sentinel: float) -> GBTRegressionModel:
    """Trees fitted on ``train``; ``n_parts`` is the number of partitions MLlib's sample refers to."""
    spark = train.sparkSession
    k = len(features)

    def narrow(df: DataFrame) -> DataFrame:
        values = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_x{i}") for i, f in enumerate(features)]
        lacking = F.lit(float("nan"))
        return df.select(*ID_COLUMNS, *values, F.coalesce(F.col(target).cast("double"), lacking).alias("_y"), F.coalesce(F.col(weight).cast("double"), lacking).alias("_w"))

    inputs = [f"_x{i}" for i in range(k)]
    data = narrow(train)
    rows, fraction, mass, total = _sampled(data, n_parts, params.max_bins, params.seed)
    sample = rows.select(*inputs, "_w").toArrow()  # bounded by the sample
    w = sample.column("_w").to_numpy()
    columns = [sample.column(c).to_numpy() for c in inputs]
    missing = [np.isnan(x) for x in columns]
    columns = [np.where(m, sentinel, x) for x, m in zip(columns, missing, strict=True)] + [m.astype(float) for m in missing]
    if not (np.isfinite(w).all() and math.isfinite(mass)):
        raise ValueError("boosted trees need finite weights that are not negative")
    # the weight of a sample of this share, so rows that were not drawn change nothing
    most = max(1, min(params.max_bins, sample.num_rows)) - 1
    cuts = [thresholds(x, w, most, fraction * mass) for x in columns]

    kind = "uint8" if 2 * (most + 1) <= 256 else "uint16"
    kept = []

    def stored(df: DataFrame) -> RDD:
        # a record is a chunk of rows: scans hand them to the workers as they are
        kept.append(checkpoint_path(spark, f"bins_{uuid.uuid4().hex[:10]}"))
        chunks = df.select(*inputs, "_y", "_w").mapInArrow(_binned(cuts, k, kind, sentinel), "n int, chunk binary")
        chunks.rdd.map(lambda r: (r[0], bytes(r[1]))).saveAsPickleFile(kept[-1], 1)
        return spark.sparkContext.pickleFile(kept[-1]).coalesce(max(8, -(-total // ROWS_PER_TASK)))

    try:
        booster = _Booster(stored(data), cuts, params.max_depth, kind)
        held_out = stored(narrow(valid)) if valid is not None else None
        roots, trees, weights = [], [], []
        best, best_error = params.max_iter, math.inf
        for m in range(params.max_iter):
            root, splits = booster.tree(trees)
            weights.append(1.0 if m == 0 else params.step_size)
            roots.append(_merged(root))
            trees.append(booster.grown(root, splits, weights[-1]))
            if held_out is not None:
                error = booster.error(held_out, trees)
                if m == 0:
                    best, best_error = 1, error
                elif best_error - error < params.validation_tol * max(error, 0.01):
                    break
                elif error < best_error:
                    best, best_error = m + 1, error
        return _model(spark, roots[:best], weights[:best], cuts)
    finally:
        for path in kept:
            remove_path(spark, path)
