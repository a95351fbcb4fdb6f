"""Boosted trees as linear models of their leaves: refit and early stopping in one pass.

A booster predicts ``Σ contribution[leaf]`` over the leaves a row falls into, one in each
tree, so the leaves are one-hot inputs of a linear model. With ``Z`` the rows' leaves, one
aggregation gives ``G = Σ w·z·zᵀ`` (the weight that any two leaves share), ``b = Σ w·z·y``,
``c = Σ w·y²`` and the number of rows. What follows is algebra on these numbers:

- refit (K03): a tree's fresh leaf value is the weighted mean residual after the trees
  before it, ``(b - G·contributions) / (weight of the leaf)``, tree by tree;
- staged losses (K01): the first ``k`` trees have the error ``c - 2·xᵀb + xᵀGx`` with the
  other trees' contributions at zero, so one pass scores every prefix of the booster;
- walk-forward with refits: statistics per model version give every version's leaves and
  the score of the days it predicts.

Rows without a target or a weight (null or NaN) count nowhere. A group's statistics hold at
most ``(trees · 2^depth)² / 2`` numbers whatever the number of rows; they are summed inside
the tasks and then by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.columns import DATE, TARGET_COLUMN, WEIGHT_COLUMN
from tidepanel.operators.splits import NestedSplit, cadence_schedule
from tidepanel.plans import gbt
from tidepanel.plans.gbt import GBTParams, TreeModel

TARGET_ROW, COUNT_ROW = -1, -2  # stand for a leaf in rows of b, c and n
HELD_CELLS = 4_000_000  # numbers a task holds before it passes its sums on


@dataclass
class Leaves:
    """All leaves of a booster, tree after tree: ``first[t]`` is tree ``t``'s first leaf."""

    first: np.ndarray
    value: np.ndarray
    weight: np.ndarray  # of each tree

    @property
    def contribution(self) -> np.ndarray:
        return self.value * np.repeat(self.weight, np.diff(self.first))


@dataclass
class LeafStats:
    """Statistics of one group of rows over the leaves of a booster."""

    g: np.ndarray
    b: np.ndarray
    c: float
    n: int

    def __add__(self, other: LeafStats) -> LeafStats:
        return LeafStats(self.g + other.g, self.b + other.b, self.c + other.c, self.n + other.n)

    def sse(self, contribution: np.ndarray) -> float:
        return float(self.c - 2 * contribution @ self.b + contribution @ self.g @ contribution)


def leaves_of(model: TreeModel) -> Leaves:
    """The current leaf values (after refits, if there were any)."""
    table = model.leaf_table if model.leaf_table is not None else gbt.leaf_table(model, gbt.SparkSession.getActiveSession())
    rows = table.select("tree", "leaf", "value").orderBy("tree", "leaf").collect()  # bounded by trees x 2^depth
    sizes = np.bincount([r["tree"] for r in rows], minlength=len(model.base.trees))
    return Leaves(np.concatenate([[0], np.cumsum(sizes)]), np.array([r["value"] for r in rows]), np.array(model.base.treeWeights))


def _sums(first: np.ndarray):
    """(grp, a, b, v): a task's nonzero sums."""
    size = int(first[-1])
    trees = len(first) - 1

    def flush(held: dict):
        import pyarrow as pa

        for grp, (g, b, c, n) in held.items():
            i, j = np.nonzero(g)
            k = np.nonzero(b)[0]
            a = np.concatenate([i, k, [TARGET_ROW, COUNT_ROW]])
            other = np.concatenate([j, np.full(len(k), TARGET_ROW), [TARGET_ROW, COUNT_ROW]])
            v = np.concatenate([g[i, j], b[k], [c, float(n)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), grp, np.int64)), pa.array(a.astype(np.int32)), pa.array(other.astype(np.int32)), pa.array(v)],
                                             names=["grp", "a", "b", "v"])

    def run(batches: Iterator):
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            leaf = np.asarray(batch.column(3).flatten(), np.int64).reshape(batch.num_rows, trees)
            for key in np.unique(grp).tolist():
                own = grp == key
                if key not in held:
                    if (len(held) + 1) * size * size > HELD_CELLS and held:
                        yield from flush(held)
                        held = {}
                    held[key] = [np.zeros((size, size)), np.zeros(size), 0.0, 0]
                sums = held[key]
                yk, wk, lk = y[own], w[own], leaf[own]
                for s in range(trees):
                    rows = slice(first[s], first[s + 1])
                    sums[1][rows] += np.bincount(lk[:, s], weights=wk * yk, minlength=first[s + 1] - first[s])
                    for t in range(s, trees):  # the lower triangle is its mirror
                        m, k = first[s + 1] - first[s], first[t + 1] - first[t]
                        both = np.bincount(lk[:, s] * k + lk[:, t], weights=wk, minlength=m * k)
                        sums[0][rows, first[t]:first[t + 1]] += both.reshape(m, k)
                sums[2] += float((wk * yk * yk).sum())
                sums[3] += len(yk)
        yield from flush(held)
    return run


def leaf_statistics(model: TreeModel, df: DataFrame, group: Column | None = None, target: str = TARGET_COLUMN,
                    weight: str = WEIGHT_COLUMN) -> DataFrame:
    """``grp, a, b, v``: the sums of each group of rows, one row per nonzero number (a <= b).

    One scan; what is shuffled are sums per task and group, never rows.
    """
    first = leaves_of(model).first
    group = F.lit(0) if group is None else group
    x = gbt._leaves(model, gbt.assemble(df.withColumn("_grp", group.cast("long")), model.features))
    y, w = F.col(target).cast("double"), F.col(weight).cast("double")
    x = x.where(y.isNotNull() & ~F.isnan(y) & w.isNotNull() & ~F.isnan(w) & F.col("_grp").isNotNull())
    x = x.select("_grp", y.alias("y"), w.alias("w"), F.col("_leaves").cast("array<int>").alias("leaves"))
    return x.mapInArrow(_sums(first), "grp long, a int, b int, v double").groupBy("grp", "a", "b").agg(F.sum("v").alias("v"))


def gathered(stats: DataFrame, leaves: Leaves) -> dict[int, LeafStats]:
    """The sums of each group as arrays on the driver (bounded by groups x leaves²)."""
    table = stats.toArrow()
    grp, a, b, v = (table.column(c).to_numpy() for c in ("grp", "a", "b", "v"))
    size = int(leaves.first[-1])
    out = {}
    for key in np.unique(grp).tolist():
        own = grp == key
        i, j, x = a[own], b[own], v[own]
        g = np.zeros((size, size))
        pair = j >= 0
        g[i[pair], j[pair]] = x[pair]
        g = np.triu(g) + np.triu(g, 1).T
        lin = np.zeros(size)
        single = (i >= 0) & (j == TARGET_ROW)
        lin[i[single]] = x[single]
        out[key] = LeafStats(g, lin, float(x[(i == TARGET_ROW) & (j == TARGET_ROW)].sum()), int(x[i == COUNT_ROW].sum()))
    return out


# ---------------------------------------------------------------- refit
def refreshed(leaves: Leaves, stats: LeafStats, decay: float) -> Leaves:
    """Leaf values blended ``decay·old + (1 - decay)·fresh``, tree by tree.

    Leaves that no weight reaches keep their value.
    """
    value = leaves.value.copy()
    x = np.zeros(len(value))
    for t, weight in enumerate(leaves.weight):
        own = slice(leaves.first[t], leaves.first[t + 1])
        mass = np.diag(stats.g)[own]
        rest = stats.b[own] - stats.g[own, :own.start] @ x[:own.start]
        hit = mass > 0
        fresh = np.divide(rest, mass * weight, out=np.zeros(len(mass)), where=hit)
        value[own] = np.where(hit, decay * value[own] + (1 - decay) * fresh, value[own])
        x[own] = weight * value[own]
    return Leaves(leaves.first, value, leaves.weight)


def _with_leaves(model: TreeModel, leaves: Leaves) -> TreeModel:
    rows = [(t, float(i), float(v), float(w), float(w * v)) for t, w in enumerate(leaves.weight)
            for i, v in enumerate(leaves.value[leaves.first[t]:leaves.first[t + 1]])]
    table = gbt.SparkSession.getActiveSession().createDataFrame(rows, "tree int, leaf double, value double, weight double, contribution double")
    return TreeModel(model.features, model.base, table, list(model.residual_stages))


def refit(model: TreeModel, new: DataFrame, decay: float = 0.9, target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN) -> TreeModel:
    """Leaf values refreshed on ``new`` rows, one Spark job whatever the number of trees."""
    leaves = leaves_of(model)
    stats = gathered(leaf_statistics(model, new, None, target, weight), leaves)
    return _with_leaves(model, refreshed(leaves, stats[0], decay)) if stats else model


def refit_walk_forward(model: TreeModel, df: DataFrame, split: NestedSplit, cadence: int, decay: float = 0.9,
                       target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN) -> DataFrame:
    """K03 + K10: the test block with a refit every ``cadence`` days, from one aggregation.

    Version ``v`` predicts the days ``v·cadence`` to ``(v + 1)·cadence - 1`` of the block and
    is refreshed on the days version ``v - 1`` predicted. One row per version: ``version,
    n_rows, sse, sst, r2`` of its days.
    """
    leaves = leaves_of(model)
    days = cadence_schedule(df, split.test_start, split.test_end, cadence).select(DATE, "version")  # one row per test day
    test = df.where(F.col(DATE).between(split.test_start, split.test_end)).join(F.broadcast(days), DATE)
    stats = gathered(leaf_statistics(model, test, F.col("version"), target, weight), leaves)
    rows = []
    for v in sorted(stats):
        if v - 1 in stats:
            leaves = refreshed(leaves, stats[v - 1], decay)
        s = stats[v]
        sse = s.sse(leaves.contribution)
        rows.append((v, s.n, sse, s.c, 1 - sse / s.c if s.c > 0 else None))
    return df.sparkSession.createDataFrame(rows, "version long, n_rows long, sse double, sst double, r2 double")


# ---------------------------------------------------------------- early stopping
def staged_losses(leaves: Leaves, stats: LeafStats) -> list[float]:
    """Sum of weighted squared errors of the first 1, 2, ... trees."""
    contribution = leaves.contribution
    x, out = np.zeros(len(contribution)), []
    for t in range(len(leaves.weight)):
        own = slice(leaves.first[t], leaves.first[t + 1])
        x[own] = contribution[own]
        out.append(stats.sse(x))
    return out


def best_round(losses: list[float], patience: int) -> tuple[int, int]:
    """``(best, last)`` round, counted from 1, when training ends after ``patience`` rounds without gain."""
    best = 1
    for k, loss in enumerate(losses, 1):
        if loss < losses[best - 1]:
            best = k
        if k - best >= patience:
            return best, k
    return best, len(losses)


def first_trees(model: TreeModel, k: int) -> TreeModel:
    """The booster of the first ``k`` trees."""
    sc = gbt.SparkSession.getActiveSession().sparkContext
    full = model.base._java_obj
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k)
    weights = sc._gateway.new_array(sc._jvm.double, k)
    for i in range(k):
        trees[i] = full.trees()[i]
        weights[i] = float(model.base.treeWeights[i])
    cut = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(full.uid() + f"_first{k}", trees, weights, full.numFeatures())
    return TreeModel(model.features, GBTRegressionModel(cut))


def fit_early_stopping(train: DataFrame, valid: DataFrame, features: list[str], params: GBTParams, patience: int,
                       target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN) -> tuple[TreeModel, DataFrame]:
    """The booster cut at its best round on ``valid``, and the history of the rounds.

    All ``max_iter`` trees are grown on ``train``; one pass over ``valid`` gives the weighted
    loss after every round. The rounds up to the first that ends ``patience`` rounds without
    gain count, the best of them is restored. History: ``round, loss`` (weighted mean
    squared error), ``r2, is_best``. Without usable validation rows nothing is cut.
    """
    model = gbt.fit(train, features, params, target, weight)
    leaves = leaves_of(model)
    stats = gathered(leaf_statistics(model, valid, None, target, weight), leaves)
    schema = "round int, loss double, r2 double, is_best boolean"
    if not stats:
        return model, train.sparkSession.createDataFrame([], schema)
    s = stats[0]
    losses = staged_losses(leaves, s)
    best, last = best_round(losses, patience)
    mass = float(np.diag(s.g)[:leaves.first[1]].sum())  # every row is in one leaf of the first tree
    rows = [(k, x / mass if mass > 0 else None, 1 - x / s.c if s.c > 0 else None, k == best) for k, x in enumerate(losses[:last], 1)]
    return first_trees(model, best), train.sparkSession.createDataFrame(rows, schema)
