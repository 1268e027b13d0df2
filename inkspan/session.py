"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app="inkspan", master=None, cores=None, memory="12g"):
    """A session with the settings the operators expect.

    On a cluster the master and sizes come from spark-submit; ``master`` is only
    passed for local runs.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        n = cores or os.cpu_count() or 4
        b = (
            b.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", memory)
            .config("spark.sql.shuffle.partitions", str(n))
        )
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """SQL settings for jobs whose compact inputs expand a hundredfold inside a stage.

    Adaptive execution sizes partitions by what was shuffled, not by what a generator makes of
    it; a low floor keeps small shuffled inputs spread over all cores. Large inputs are still
    cut at the advisory size.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only where that setting is absent in a single-process session (tests, a laptop) is a fresh
    folder made, once a session.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


EXPANDED = 2_000_000  # rows a task makes of its compact rows, on average


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash-partition compact rows by ``keys`` before they are expanded to ``rows`` rows.

    The partition count is given outright so that adaptive execution does not merge
    partitions that are small now and large after the expansion; it grows with ``rows``, so a
    task's share does not. Aggregates, windows and joins on the keys downstream reuse this partitioning.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(n, -(-rows // EXPANDED)), *keys)


def share_of(df: DataFrame, size) -> int:
    """The rows that ``df`` expands to, as its column ``size`` has them a row; what ``spread`` deals over tasks."""
    return int(df.agg(F.sum(size)).first()[0] or 0)


def beside(df: DataFrame) -> DataFrame:
    """A table of a few rows a key, hashed in each task: expanded rows that meet it are neither sorted nor broadcast.

    Spark judges expanded rows by the size of the file they come from, so without this it may broadcast them.
    """
    return df.hint("shuffle_hash")


def small_side(df: DataFrame, rows: int = 400_000) -> DataFrame:
    """A lookup table computed once into the shared folder, counted there, and broadcast up to ``rows`` rows.

    Beyond that it is joined by shuffle, with adaptive splitting of skewed partitions.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= rows else df
