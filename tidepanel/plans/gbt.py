"""Boosted trees on Spark ML: fit with early stopping, predict, refit, continue.

Trees are built level-wise from distributed histograms (one job per level), so the fit
scales with the cluster; the models are MLlib's. MLlib rejects NaN: missing values become a
sentinel plus a missing-indicator column, so trees can still route them separately.

Update strategies keep the tree structure in Spark tables:

- ``refit``: leaf values re-estimated on new rows, tree by tree (each tree sees the
  residual of the already refreshed trees), blended ``decay·old + (1-decay)·new``;
  a leaf table (tree, leaf, value) has at most ``trees x 2^depth`` rows. The walk-forward
  takes the one-pass form of :mod:`tidepanel.plans.leaf_stats`; ``refit`` here reads the rows
  once per tree and stands for its definition.
- ``continue``: a small booster fitted on the residual of the current model; the
  prediction is the sum of the stages.
- ``retrain``: a fresh fit on the expanding history at each update boundary.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.columns import ID_COLUMNS, SYMBOL, TARGET_COLUMN, WEIGHT_COLUMN
from tidepanel.plans import boosting
from tidepanel.session import reliable_checkpoint

SENTINEL = -1.0e9


@dataclass
class GBTParams:
    max_iter: int = 20
    step_size: float = 0.1
    max_depth: int = 4
    max_bins: int = 64
    subsampling_rate: float = 1.0
    feature_subset: str = "all"
    seed: int = 42
    validation_tol: float = 0.01
    num_partitions: int | None = None


@dataclass
class TreeModel:
    """A fitted booster plus the stages added by updates."""

    features: list[str]
    base: GBTRegressionModel
    leaf_table: DataFrame | None = None  # refreshed (tree, leaf, value) after a refit
    residual_stages: list[GBTRegressionModel] = field(default_factory=list)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """NaN/NULL -> sentinel plus ``<f>_missing`` indicators, then one vector column."""
    cols = []
    for f in features:
        x = F.col(f).cast("double")
        bad = x.isNull() | F.isnan(x)
        cols += [F.when(bad, F.lit(SENTINEL)).otherwise(x).alias(f"_v_{f}"),
                 bad.cast("double").alias(f"_m_{f}")]
    tmp = df.select("*", *cols)
    names = [f"_v_{f}" for f in features] + [f"_m_{f}" for f in features]
    va = VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep")
    return va.transform(tmp).drop(*names)


ROWS_PER_PARTITION = 200_000


def _partitions(rows: int) -> int:
    return max(8, -(-rows // ROWS_PER_PARTITION))


def _stable(df: DataFrame, n: int | None) -> DataFrame:
    # Trees are deterministic for a fixed seed *and* partitioning: fix both. The number
    # of partitions follows the rows, never the cores, so the same data gives the same
    # trees on any cluster. Hashing on (symbol, date) keeps partitions even when one
    # symbol dominates.
    n = n or _partitions(df.count())
    keys = [c for c in ID_COLUMNS if c in df.columns]
    part = [c for c in (SYMBOL, "date_id") if c in df.columns]
    return df.repartition(n, *part).sortWithinPartitions(*keys)


def fit(train: DataFrame, features: list[str], params: GBTParams, target: str = TARGET_COLUMN,
        weight: str = WEIGHT_COLUMN, valid: DataFrame | None = None) -> TreeModel:
    """Weighted boosted trees; early stopping on ``valid`` when given.

    The trees are grown from stored bins (:mod:`tidepanel.plans.boosting`); MLlib's own fit, which
    gives the same trees, stands for settings that draw rows or inputs per tree.
    """
    frames = [train] if valid is None else [train, valid]
    if boosting.fits(params, *frames):
        n = params.num_partitions or _partitions(sum(df.count() for df in frames))
        return TreeModel(features, boosting.grow(train, features, params, target, weight, valid, n, SENTINEL))
    return _fit_mllib(train, features, params, target, weight, valid)


def _fit_mllib(train: DataFrame, features: list[str], params: GBTParams, target: str = TARGET_COLUMN,
               weight: str = WEIGHT_COLUMN, valid: DataFrame | None = None) -> TreeModel:
    data = train.withColumn("_is_valid", F.lit(False))
    if valid is not None:
        data = data.unionByName(valid.withColumn("_is_valid", F.lit(True)))
    data = _stable(assemble(data, features), params.num_partitions)
    gbt = GBTRegressor(featuresCol="features", labelCol=target, weightCol=weight, maxIter=params.max_iter,
                       stepSize=params.step_size, maxDepth=params.max_depth, maxBins=params.max_bins,
                       subsamplingRate=params.subsampling_rate, featureSubsetStrategy=params.feature_subset,
                       seed=params.seed, validationTol=params.validation_tol)
    if valid is not None:
        gbt = gbt.setValidationIndicatorCol("_is_valid")
    return TreeModel(features, gbt.fit(data))


def _leaves(model: TreeModel, df: DataFrame) -> DataFrame:
    m = model.base.copy()
    m.setLeafCol("_leaves")
    m.setPredictionCol("_unused_pred")
    return m.transform(df).withColumn("_leaves", vector_to_array("_leaves")).drop("_unused_pred")


def predict(model: TreeModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Predictions attached to the rows' keys (no positional alignment)."""
    x = assemble(df, model.features)
    if model.leaf_table is None:
        pred = model.base.transform(x).withColumnRenamed("prediction", "_base")
    else:
        # Refreshed leaf values: the leaf table is bounded (trees x 2^depth rows) and holds
        # every leaf, so it is inlined as an array per tree, read by the leaf's index.
        values: list[list[float]] = [[] for _ in model.base.trees]
        for r in model.leaf_table.select("tree", "leaf", "contribution").orderBy("tree", "leaf").collect():
            values[int(r["tree"])].append(float(r["contribution"]))
        lut = F.array(*[F.lit(v) for v in values])
        lv = _leaves(model, x)
        total = F.aggregate(
            F.transform("_leaves", lambda leaf, t: F.get(F.get(lut, t), leaf.cast("int"))),
            F.lit(0.0), lambda acc, v: acc + v)
        pred = lv.withColumn("_base", total).drop("_leaves")
    for i, stage in enumerate(model.residual_stages):
        pred = stage.transform(pred.withColumnRenamed("_base", f"_b{i}")).withColumn(
            "_base", F.col(f"_b{i}") + F.col("prediction")).drop("prediction", f"_b{i}")
    return pred.withColumnRenamed("_base", out).drop("features")


def _leaf_values(node) -> list[float]:
    """Predictions of the leaves below a node, from left to right."""
    if node.subtreeDepth() == 0:
        return [float(node.prediction())]
    return _leaf_values(node.leftChild()) + _leaf_values(node.rightChild())


def leaf_table(model: TreeModel, spark: SparkSession) -> DataFrame:
    """(tree, leaf, value, weight, contribution) of every leaf of the booster.

    Read from the nodes of the trees, so leaves that no current row reaches keep their
    value. Leaves are numbered from left to right, as the leaf column does.
    """
    rows = []
    for t, tree in enumerate(model.base.trees):
        w = float(model.base.treeWeights[t])
        rows += [(t, float(i), v, w, w * v) for i, v in enumerate(_leaf_values(tree._java_obj.rootNode()))]
    return spark.createDataFrame(rows, "tree int, leaf double, value double, weight double, contribution double")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Materialise a small intermediate table in the shared checkpoint folder."""
    import uuid

    from tidepanel.session import checkpoint_path

    path = checkpoint_path(df.sparkSession, f"gbt_{name}_{uuid.uuid4().hex[:10]}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def refit(model: TreeModel, new: DataFrame, decay: float = 0.9, target: str = TARGET_COLUMN,
          weight: str = WEIGHT_COLUMN) -> TreeModel:
    """Leaf values refreshed on ``new`` rows tree by tree, blended with the old ones.

    A leaf's fresh value is the weighted mean residual of its rows: the sample weights
    that the fit uses hold here as well. Leaves without new rows keep their value.

    One small aggregation per tree (the leaf table is bounded by 2^depth rows per tree);
    the running prediction is checkpointed every few trees to cut lineage.
    """
    old = model.leaf_table if model.leaf_table is not None else leaf_table(model, new.sparkSession)
    x = _leaves(model, assemble(new, model.features)).select(target, weight, "_leaves").withColumn(
        "_cur", F.lit(0.0))
    tables = []
    n_trees = len(model.base.trees)
    for t in range(n_trees):
        leaf = F.element_at("_leaves", t + 1)
        wt = float(model.base.treeWeights[t])
        stats = x.groupBy(leaf.alias("leaf")).agg(
            (F.sum(F.col(weight) * (F.col(target) - F.col("_cur"))) / F.sum(weight) / F.lit(wt)).alias("fresh"))
        ot = old.where(F.col("tree") == t).select("leaf", F.col("value").alias("old"))
        blended = ot.join(stats, "leaf", "left").select(
            F.lit(t).alias("tree"), "leaf",
            F.when(F.col("fresh").isNull(), F.col("old"))
            .otherwise(decay * F.col("old") + (1 - decay) * F.col("fresh")).alias("value"),
            F.lit(wt).alias("weight"))
        blended = _written(blended.withColumn("contribution", F.col("weight") * F.col("value")), f"leaf_t{t}")
        tables.append(blended)
        upd = F.broadcast(blended.select(F.col("leaf").alias("_l"), "contribution"))
        x = x.join(upd, leaf == F.col("_l"), "left").select(
            target, weight, "_leaves", (F.col("_cur") + F.coalesce("contribution", F.lit(0.0))).alias("_cur"))
        if t % 5 == 4:
            x = reliable_checkpoint(x)
    lt = tables[0]
    for b in tables[1:]:
        lt = lt.unionByName(b)
    return TreeModel(model.features, model.base, _written(lt, "leaf_table"), list(model.residual_stages))


def continue_training(model: TreeModel, new: DataFrame, rounds: int, params: GBTParams,
                      target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN) -> TreeModel:
    """``rounds`` more trees fitted on the residual of the current model on ``new``."""
    pred = predict(model, new, "_cur")
    res = pred.withColumn("_resid", F.col(target) - F.col("_cur"))
    p = GBTParams(**{**params.__dict__, "max_iter": rounds})
    stage = fit(res, model.features, p, target="_resid", weight=weight).base
    return TreeModel(model.features, model.base, model.leaf_table, list(model.residual_stages) + [stage])


def feature_importance(model: TreeModel, top: int | None = None) -> DataFrame:
    """Impurity-gain importances (value + missing indicator summed per input)."""
    # The importance vector has one entry per model input (bounded by the column count).
    imp = model.base.featureImportances.toArray().tolist()
    k = len(model.features)
    rows = [(f, float(imp[i] + imp[i + k])) for i, f in enumerate(model.features)]
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    df = ss.createDataFrame(rows, "feature string, importance double")
    ordered = df.orderBy(F.desc("importance"), F.asc("feature"))
    return ordered.limit(top) if top else ordered


def walk_forward(df: DataFrame, features: list[str], split, variant: str, cadence: int,
                 params: GBTParams, decay: float = 0.9, continue_rounds: int = 3,
                 target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN) -> tuple[DataFrame, int]:
    """K10 with boosted trees: test-block predictions of every model version.

    The driver loops over update boundaries only (``ceil(test_days / cadence)`` model
    versions); each version predicts its days in one distributed ``transform``.
    Returns (predictions, n_updates).
    """
    from tidepanel.columns import DATE

    test = df.where(F.col(DATE).between(split.test_start, split.test_end))
    days = [r[DATE] for r in test.select(DATE).distinct().orderBy(DATE).collect()]  # one row per test day
    train = df.where(F.col(DATE).between(split.train.train_start, split.train.train_end))
    es = df.where(F.col(DATE).between(split.es_start, split.es_end))
    model = fit(train, features, params, target, weight, valid=es)
    step = len(days) if variant == "full" else cadence
    parts = []
    n_updates = 0
    for v, lo in enumerate(range(0, len(days), step)):
        if v > 0:
            new = df.where(F.col(DATE).between(days[lo - step], days[lo - 1]))
            if variant == "refit":
                from tidepanel.plans import leaf_stats
                model = leaf_stats.refit(model, new, decay, target, weight)
            elif variant == "continue":
                model = continue_training(model, new, continue_rounds, params, target, weight)
            elif variant == "retrain":
                hist = df.where((F.col(DATE) <= split.es_end) & (F.col(DATE) >= split.train.train_start)
                                & ((F.col(DATE) <= split.train.train_end) | (F.col(DATE) >= split.es_start)))
                hist = hist.unionByName(df.where(F.col(DATE).between(days[0], days[lo - 1])))
                model = TreeModel(features, fit(hist, features, GBTParams(
                    **{**params.__dict__, "max_iter": model.base.getNumTrees}), target, weight).base)
            n_updates += 1
        chunk = test.where(F.col(DATE).between(days[lo], days[min(lo + step, len(days)) - 1]))
        parts.append(predict(model, chunk).withColumn("version", F.lit(v)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, n_updates


def save(model: TreeModel, path: str) -> None:
    """Persist the booster, its refreshed leaf table and residual stages."""
    model.base.write().overwrite().save(os.path.join(path, "base"))
    if model.leaf_table is not None:
        model.leaf_table.write.mode("overwrite").parquet(os.path.join(path, "leaf_table"))
    for i, st in enumerate(model.residual_stages):
        st.write().overwrite().save(os.path.join(path, f"stage_{i}"))
    SparkSession.getActiveSession().createDataFrame(
        [(",".join(model.features), len(model.residual_stages), model.leaf_table is not None)],
        "features string, n_stages int, has_leaf_table boolean").write.mode("overwrite").parquet(
        os.path.join(path, "meta"))


def load(path: str) -> TreeModel:
    spark = SparkSession.getActiveSession()
    meta = spark.read.parquet(os.path.join(path, "meta")).first()
    lt = spark.read.parquet(os.path.join(path, "leaf_table")) if meta["has_leaf_table"] else None
    stages = [GBTRegressionModel.load(os.path.join(path, f"stage_{i}")) for i in range(meta["n_stages"])]
    return TreeModel(meta["features"].split(","), GBTRegressionModel.load(os.path.join(path, "base")), lt, stages)
