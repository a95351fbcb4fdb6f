from tidepanel.functions.exprs import (
    fill_null,
    is_finite,
    nan_to_null,
    no_nan,
)

__all__ = ["fill_null", "is_finite", "nan_to_null", "no_nan"]
