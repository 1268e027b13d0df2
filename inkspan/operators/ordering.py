"""Numbering and running sums inside groups that may be far too large for one task.

A plain window puts a whole group in one task. Here the group is cut into chunks of
neighbouring positions: each chunk is numbered on its own and a window over one row per
chunk supplies the offsets, so a hot group is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536


def running_sum(df: DataFrame, group, pos: str, value: Column, out: str, chunk=CHUNK, lead=()):
    """``out`` = inclusive running sum of ``value`` over (lead..., pos) in each group.

    ``pos`` is an integer column; ``lead`` names columns ordered before it.
    """
    group, lead = list(group), list(lead)
    keyed = df.withColumn("_chunk", F.floor(F.col(pos) / chunk)).withColumn("_v", value)
    ck = group + lead + ["_chunk"]
    totals = keyed.groupBy(*ck).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy(*lead, "_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(*ck, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*ck).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ck]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return (
        keyed.withColumn("_in", F.sum("_v").over(inner)).alias("a")
        .join(offsets.alias("b"), cond)
        .select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("_in") + F.col("_off")).alias(out))
    )


def running_number(df: DataFrame, group, pos: str, out: str, chunk=CHUNK, lead=()):
    """1-based row number over (lead..., pos) in each group; ``pos`` unique per lead."""
    return running_sum(df, group, pos, F.lit(1), out, chunk, lead)
