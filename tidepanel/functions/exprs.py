"""Column-expression helpers (H01-H05). All JVM-side, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_null(c: ColumnOrName, value: float = 0.0) -> Column:
    """``fill_null(value)``."""
    return F.coalesce(_c(c), F.lit(value))


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN -> NULL so that ``avg`` / ``stddev`` behave like numpy's ``nan*`` reducers."""
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def is_finite(c: ColumnOrName) -> Column:
    """True for non-null values that are neither NaN nor +-inf."""
    col = _c(c).cast("double")
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def no_nan(c: str) -> Column:
    """The column as double; a NaN or infinite value stops the query (null passes)."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | is_finite(x), x).otherwise(F.raise_error(F.lit(f"{c} holds a NaN or infinite value")).cast("double"))
