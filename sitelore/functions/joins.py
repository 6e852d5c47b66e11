"""Joins that stay balanced when one key holds much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more keys than this are ever sent to all tasks.
MOST_HUBS = 50_000


def hub_size(size: int) -> int:
    """Rows from which a key counts as a hub: among ``size`` rows at most ``MOST_HUBS`` keys have as many."""
    return max(256, -(-size // MOST_HUBS))


def hub_join(rows: DataFrame, found: DataFrame, keys: list[str], size: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``found``, whose rows have different ``keys`` and count in ``n`` the rows that hold them.

    ``size`` is a bound of the number of rows.  Keys of many rows are few, by
    that count, and are sent to all tasks: their rows stay where they lie.  The
    rest is shuffled by key.  Null keys find nothing; ``n`` isn't in the result.
    """
    least = hub_size(size)
    values = [c for c in found.columns if c not in (*keys, "n")]
    held = F.struct(F.lit(True).alias("_hub"), *values).alias("_held")
    hubs = F.broadcast(found.where(F.col("n") >= least).select(*keys, held))
    marked = rows.join(hubs, keys, "left")
    near = marked.where(F.col("_held").isNotNull()).select(*rows.columns, *[F.col("_held")[c].alias(c) for c in values])
    far = marked.where("_held is null").select(*rows.columns)
    return near.unionByName(far.join(found.where(F.col("n") < least).drop("n"), keys, how).select(*rows.columns, *values))
