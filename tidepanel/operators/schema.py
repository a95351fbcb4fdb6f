"""Schema guards and presence reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.columns import FEATURE_COLUMNS, ID_COLUMNS, LAG_COLUMNS, RESPONDER_COLUMNS, TARGET_COLUMN, WEIGHT_COLUMN


def require_columns(df: DataFrame, columns: list[str], who: str = "operator") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{who}: missing columns {missing}")


# Default contract checked by the presence report: ids, all features, weight, responders.
PRESENCE_REQUIRED: list[str] = ID_COLUMNS + FEATURE_COLUMNS + [WEIGHT_COLUMN] + RESPONDER_COLUMNS

PRESENCE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType(), False),
    T.StructField("family", T.StringType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("present", T.BooleanType(), False),
    T.StructField("dtype", T.StringType(), True),
    T.StructField("n_values", T.LongType(), False),
])


def _family(c: str) -> str:
    if c in ID_COLUMNS:
        return "id"
    if c in FEATURE_COLUMNS:
        return "feature"
    if c in RESPONDER_COLUMNS:
        return "responder"
    if c in LAG_COLUMNS:
        return "lag"
    if c == WEIGHT_COLUMN:
        return "weight"
    return "other"


def schema_presence(spark: SparkSession, df: DataFrame,
                    required: list[str] | None = None) -> DataFrame:
    """Column-contract report (B08): presence, type and non-null values of each required column.

    The counts come from one aggregation over the table (one row reaches the driver).
    """
    req = required if required is not None else PRESENCE_REQUIRED
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    there = [c for c in req if c in types]
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first().asDict() if there else {}
    rows = [(c, _family(c), i, c in types, types.get(c), counts.get(c, 0)) for i, c in enumerate(req)]
    return spark.createDataFrame(rows, PRESENCE_SCHEMA)
