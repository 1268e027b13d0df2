"""Incremental behaviours on Structured Streaming: inbox, bursts, mirror sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.operators.library import mirror_plan, push_batches

# Quiet gaps before a burst of changes is acted on.
GAPS = {"push": "2 seconds", "persist": "500 milliseconds", "rebuild": "250 milliseconds"}


def bursts(changes: DataFrame, gap: str = GAPS["push"], key: str = "lib_id") -> DataFrame:
    """(key, first, fires, changes): one action per burst, ``gap`` after its last change.

    A change exactly ``gap`` after the last one joins the burst. Works on tables and streams
    (a stream needs a watermark on ts).
    """
    return (
        changes.groupBy(key, F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("changes"))
        .select(key, F.col("s.start").alias("first"), F.col("s.end").alias("fires"), "changes")
    )


def stream_inbox(photos: DataFrame, processed: DataFrame) -> DataFrame:
    """Each new photo once for good: later copies (same name and size) are dropped, processed ones skipped.

    The state holds one small key a distinct photo, which offering a photo only once needs.
    """
    fresh = photos.dropDuplicates(["name", "size"])
    return fresh.join(processed.select(F.col("photo_id").alias("id")).distinct(), "id", "left_anti")


def mirror_sink(stream: DataFrame, read_mirror, read_pushed, send, record, checkpoint: str):
    """Push changed letterforms per micro-batch.

    ``send(batches)`` writes the planned rows; only after it returns does ``record(rows)`` store the
    hashes, so a failed or repeated batch is planned again and nothing is lost.
    """

    def push(df, _epoch):
        df = df.persist()
        plan = mirror_plan(df, read_mirror(), read_pushed()).persist()
        send(push_batches(plan).join(plan.where("kind = 'form'").select("lib_id", "id", "name"), ["lib_id", "id"], "left"))
        done = plan.where((F.col("kind") == "form") & (F.col("action") != "keep")).select("lib_id", "id")
        record(df.join(done, ["lib_id", "id"], "left_semi").select("lib_id", "id", "hash"))
        plan.unpersist()
        df.unpersist()

    return stream.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
