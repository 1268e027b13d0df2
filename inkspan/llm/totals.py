"""Joining rows to one total per group, whatever the number and size of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.session import cut_lineage

BROADCAST_BYTES = 16 << 20


def attach(rows: DataFrame, totals: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row a ``key``, null being a key of its own).

    The totals are computed once into the shared folder and measured there: up to ``limit`` bytes
    they are broadcast, so a hot key moves no rows; beyond that the keys are many, the join is a
    shuffle and adaptive execution splits partitions of hot keys.
    """
    totals = cut_lineage(totals)
    width = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 16 * len(totals.columns)
    small = (totals.agg(F.sum(width.cast("bigint"))).first()[0] or 0) <= limit
    right = totals.withColumnRenamed(key, "_key")
    joined = rows.join(F.broadcast(right) if small else right, F.col(key).eqNullSafe(F.col("_key")))
    return joined.drop("_key")
