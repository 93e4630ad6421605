"""Which of several versions of a record counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str, values: list[str], tie: str | None = None) -> DataFrame:
    """One row per key: ``values`` as they stand in its row with the greatest ``at``.

    The values are picked by an aggregate that combines on the map side, so a
    caller should derive small results from large texts first and call this
    afterwards: then no text is shuffled, and a key that holds very many rows
    is reduced before the exchange.

    Rows without a key are left out. A missing ``at`` is older than any other.
    Of rows equally late the one with the greatest ``tie`` counts (by default
    the values themselves), so the result doesn't depend on row order; exact
    copies count once. An empty table gives an empty table.
    """
    order = F.struct(F.col(at), F.col(tie) if tie else F.hash(*[F.col(v) for v in values]))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*[F.col(v) for v in values]), order).alias("_picked")
    )
    return picked.select(key, *[F.col(f"_picked.{v}").alias(v) for v in values])
