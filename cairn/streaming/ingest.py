"""Streams into a segment store, and a stream's newest value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cairn.operators.versions import erased, last_writes
from cairn.sources.segments import SegmentStore


def writer(changes: DataFrame, store: SegmentStore) -> DataStreamWriter:
    """Append a stream of (key, op, value) to a store, each micro-batch one commit.

    The manifest remembers the last batch, so one that is repeated after a failure is
    not appended twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        with store.lock:
            store.reload()
            if store.extra.get("last_batch", -1) >= number:
                return
            rows = last_writes(batch.select("key", "op", erased(F.col("value")).alias("value")))
            seq = store.next_seq
            name = store._write(rows.select("key", F.lit(seq).cast("long").alias("seq"), "value"))
            store._publish(store.state | {"next_seq": seq + 1, "segments": [*store.state["segments"], {"dir": name}], "extra": store.extra | {"last_batch": number}})

    return changes.writeStream.foreachBatch(apply)


def newest_per_key(changes: DataFrame) -> DataFrame:
    """Running newest value per key of a stream (update or complete mode)."""
    return changes.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count(F.lit(1)).alias("n"))
