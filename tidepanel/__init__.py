"""tidepanel: panel analytics (date x time x symbol) expressed as Spark DataFrame plans."""

from tidepanel.columns import (
    FEATURE_COLUMNS,
    ID_COLUMNS,
    RESPONDER_COLUMNS,
    TARGET_COLUMN,
    WEIGHT_COLUMN,
)

__all__ = [
    "FEATURE_COLUMNS",
    "ID_COLUMNS",
    "RESPONDER_COLUMNS",
    "TARGET_COLUMN",
    "WEIGHT_COLUMN",
]
