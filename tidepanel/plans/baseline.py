"""The baseline run (K14): engineered frame, split, boosted trees, score and artefacts.

The engineered frame is stored once and every later pass reads the columns it needs from
it; the out-of-fold predictions and the importances are stored beside it.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.columns import DATE, ID_COLUMNS, TARGET_COLUMN, WEIGHT_COLUMN
from tidepanel.operators import features as FE
from tidepanel.operators import metrics as ME
from tidepanel.operators.splits import NestedSplit
from tidepanel.plans import gbt
from tidepanel.session import checkpoint_path


@dataclass
class BaselineRun:
    """``path`` holds ``frame``, ``oof`` and ``importances`` as parquet."""

    path: str
    inputs: list[str]
    model: gbt.TreeModel
    frame: DataFrame
    oof: DataFrame
    importances: DataFrame
    summary: DataFrame


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run(panel: DataFrame, split: NestedSplit, params: gbt.GBTParams, *, features: list[str] | str | None = None,
        engineered: list[str] | str | None = "top12", window: int = 1000, symbol: bool = True, time: bool = True, use_lags: bool = True,
        use_market_avg: bool = True, use_rolling: bool = True, path: str | None = None) -> BaselineRun:
    """Fits on the train fold (stopping on the holdout) and predicts the test block.

    Inputs are the features, ``symbol_id`` and ``time_id``, lags and engineered columns in
    fixed order (``features.input_columns``).
    """
    path = path or checkpoint_path(panel.sparkSession, f"baseline_{uuid.uuid4().hex[:10]}")
    inputs = FE.input_columns(panel, features=features, symbol=symbol, time=time, use_lags=use_lags,
                              use_market_avg=use_market_avg, use_rolling=use_rolling, engineered=engineered)
    full = FE.model_frame(panel, features=features, use_lags=use_lags, use_market_avg=use_market_avg, use_rolling=use_rolling,
                          engineered=engineered, window=window)
    keep = list(dict.fromkeys([*ID_COLUMNS, WEIGHT_COLUMN, TARGET_COLUMN, *inputs]))
    frame = _stored(full.select(*keep), os.path.join(path, "frame"))
    days = F.col(DATE)
    model = gbt.fit(frame.where(days.between(split.train.train_start, split.train.train_end)), inputs, params,
                    valid=frame.where(days.between(split.es_start, split.es_end)))
    predicted = gbt.predict(model, frame.where(days.between(split.test_start, split.test_end)))
    oof = _stored(predicted.select(*ID_COLUMNS, TARGET_COLUMN, WEIGHT_COLUMN, "prediction"), os.path.join(path, "oof"))
    importances = _stored(gbt.feature_importance(model), os.path.join(path, "importances"))
    r2 = ME.weighted_r2(oof, "prediction")
    summary = r2.select(F.lit("full").alias("variant"), F.lit(0).cast("bigint").alias("cadence"), F.lit(0).cast("bigint").alias("n_updates"),
                        F.col("n_rows").alias("test_rows"), F.col("r2").alias("score"))
    return BaselineRun(path, inputs, model, frame, oof, importances, summary)
