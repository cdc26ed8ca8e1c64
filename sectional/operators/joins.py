"""Join helpers: broadcast only what has a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we will ship to every executor, in bytes (estimated from a
# row bound we can prove, never from the data's current size).
MAX_BROADCAST_BYTES = 512 * 1024 * 1024


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int,
                      limit_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when ``max_rows * row_bytes`` fits, else leave it.

    ``max_rows`` must be a bound that holds by construction (a ``limit``, a
    fixed-size dictionary, a parameter), so the decision does not depend on
    today's data volume. Above the bound Spark falls back to a shuffle join.
    """
    if max_rows * row_bytes <= limit_bytes:
        return F.broadcast(df)
    return df
