"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows x columns budget of a broadcast side (~ bytes / 8): 4M cells ~ 32 MB of doubles,
# small enough to ship to a thousand executors.
DEFAULT_BROADCAST_CELLS = 4_000_000


def bounded_broadcast(small: DataFrame, max_rows: int | None = None,
                      max_cells: int = DEFAULT_BROADCAST_CELLS) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(small), True)`` when ``small`` provably fits, else ``(small, False)``.

    The check is a plain count (partial counts per task, no rows moved); callers pass a
    materialised table. Above the bound the caller's join falls back to a shuffle join,
    which AQE may still convert or split for skew at run time.
    """
    ncols = max(1, len(small.columns))
    bound = max_rows if max_rows is not None else max(1, max_cells // ncols)
    if small.count() <= bound:
        return F.broadcast(small), True
    return small, False


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
               max_rows: int | None = None, materialize: bool = True) -> DataFrame:
    """Join a derived (aggregated) table back to ``big``; broadcast if its size is checked.

    The derived table is materialised first (reliable checkpoint), so the size check
    and the join read it instead of computing the aggregation over ``big``'s source
    twice.
    """
    if materialize:
        from tidepanel.session import reliable_checkpoint
        small = reliable_checkpoint(small)
    side, _ = bounded_broadcast(small, max_rows=max_rows)
    return big.join(side, on, how)
