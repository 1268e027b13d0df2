"""Mixing sources to target weights.

Words are counted per document and summed per source; each source's target over its size is its
repetition rate; every document is taken floor(rate) times, and once more where a draw seeded by a
hash of the document falls below the fraction that is left.

DataFrame functions throughout. Documents never move: sums per source combine map-side, and the rates,
one row a source, come back to the documents.

Defined results: a null text has no words; a null source is a source of its own, ordered last; a null
doc_id draws by its text; rows that repeat id and text draw alike; sources without words have target 0
and their documents are taken 0 times; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.totals import attach
from inkspan.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
MOST = 3  # times a source may be repeated
DRAW_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def draw(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 2^52 that depends on the document alone."""
    seed = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(seed), 1, DRAW_DIGITS), 16, 10).cast("bigint")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw) of every document: all that mixing needs of a text."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("draw"))


def weighted(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Per source its size and weight, by its place in code-point order.

    Sources are cut into ranges, numbered inside each and offset by the ranges before, so that a
    table with a source per web host is not sorted by one task.
    """
    ranged = cut_lineage(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(inside) - 1 + F.col("offset")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return ranged.join(F.broadcast(offsets), "part").select("source", "source_size", weight.cast("bigint").alias("weight"))


def rates(sizes: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size).

    Targets share the sum of all sizes by weight. Where a target would be above ``most`` times its
    source's size it stops there and the others share what is left; each pass stops every source
    that is above, so a few passes over the table of sources do. Compared in whole numbers.
    """
    table = cut_lineage(weighted(sizes, weights))
    whole = lambda c: F.col(c).cast("decimal(18,0)") if isinstance(c, str) else F.lit(c).cast("decimal(19,0)")
    ceiling = F.col("source_size") * most
    left, shares = (int(x or 0) for x in table.agg(F.sum("source_size"), F.sum("weight")).first())
    total = left
    while True:
        above = ceiling.cast("decimal(19,0)") * whole(shares) < whole("weight") * whole(left)
        stopped, free = (int(x or 0) for x in table.agg(F.sum(F.when(above, ceiling)), F.sum(F.when(~above, F.col("weight")))).first())
        if (total - stopped, free) == (left, shares):
            break
        left, shares = total - stopped, free
    share = F.least(F.col("weight").cast("double") * F.lit(left / shares if shares else 0.0), ceiling.cast("double"))
    target = F.when(above, ceiling.cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies() -> Column:
    """How often a document with a ``draw`` is taken at its source's ``rate``."""
    whole = F.floor("rate")
    return whole + F.when(F.col("draw") < (F.col("rate") - whole) * F.lit(float(16**DRAW_DIGITS)), 1).otherwise(0)


def _rates_of(sized: DataFrame, weights, most) -> DataFrame:
    return rates(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)


def plan(docs: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken (words the mix takes of it)."""
    sized = cut_lineage(counted(docs))
    out = attach(sized, _rates_of(sized, weights, most), "source").withColumn("copies", copies())
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each as often as it is taken."""
    sized = docs.select("source", n_words(F.col("text")).alias("size"))
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select("source", draw(F.col("doc_id"), F.col("text")).alias("draw"), kept)
    taken = attach(rows, _rates_of(sized, weights, most), "source").withColumn("copies", copies()).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
