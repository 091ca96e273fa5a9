"""Size checks that decide between a broadcast and a shuffle join.

A side is broadcast only when a bounded count proves it small; beyond the bound
the plain DataFrame is returned and Spark shuffles (AQE may still turn the join
into a broadcast from runtime statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows above which a dimension is never broadcast by hand.
BROADCAST_MAX_ROWS = 200_000


def row_count_at_most(df: DataFrame, limit: int) -> int:
    """Exact row count if it is <= limit, else limit + 1 (stops early)."""
    return df.limit(limit + 1).count()


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` if it holds at most ``max_rows`` rows, else ``df`` unchanged."""
    if row_count_at_most(df, max_rows) <= max_rows:
        return F.broadcast(df)
    return df
