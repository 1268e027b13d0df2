"""Bounded training samples and the learning-row rule shared by the fitted operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.session import small_side


def remainder(mod: int):
    """crc32 of the doc_id as text, modulo ``mod``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod, F.lit(0))


def thin(rows: DataFrame, most: int, *keys) -> DataFrame:
    """About ``most`` of the rows, chosen by a hash of the keys: a share of them that depends on their number alone."""
    n = rows.count()
    share = min(1.0, most / n) if n else 1.0
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30)))


def thin_each(rows: DataFrame, most: int, group: str, *keys) -> DataFrame:
    """About ``most`` of the rows of each group, all of a group that has no more; a group's share depends on its own number alone.

    ``group`` has few values, which are counted into one broadcast row each.
    """
    share = small_side(rows.groupBy(group).agg(F.least(F.lit(1.0), most / F.count("*")).alias("_share")))
    return rows.join(share, group).where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < (F.col("_share") * (1 << 30)).cast("bigint")).drop("_share")


def _labels(labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """(doc_id, y) of labels outside the held-out remainder; a repeated id counts once, with its largest label."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return ids.where(remainder(mod) != held).groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """(doc_id, y, text) of all labelled documents outside the held-out remainder, whole."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(small_side(_labels(labels, label, mod, held)), "doc_id").select("doc_id", "y", "text")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, chars: int) -> DataFrame:
    """(y, text) of at most about ``most`` labelled documents outside the held-out remainder.

    Documents of more than ``chars`` characters are not learned from, so the sample's size is bounded.
    A repeated id counts once, with its largest label.
    """
    ids = thin(_labels(labels, label, mod, held), most, "doc_id")
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars)
    return docs.join(F.broadcast(ids), "doc_id").select("y", "text")  # bounded: ``most`` rows of two numbers
