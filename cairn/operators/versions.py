"""Reads of a change log ``(key, seq, value)``, in which a null value is a deletion.

``latest`` is the core of all: sequence filter, then one hash aggregation with partial
aggregation, then deletions dropped.  Filters on the key pass through it down to the
scan; filters on the value belong above it, or older versions would show through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def erased(value: Column) -> Column:
    """An empty value is a deletion."""
    return F.when(F.octet_length(value) > 0, value)


def newest(log: DataFrame, before: int | None = None) -> DataFrame:
    """key, seq, value of each key's newest version, deletions included, among
    versions with a sequence number under ``before``."""
    if before is not None:
        log = log.where(F.col("seq") < F.lit(before))
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


def latest(log: DataFrame, before: int | None = None) -> DataFrame:
    return newest(log, before).where(F.col("value").isNotNull())


def between(df: DataFrame, start=None, end=None) -> DataFrame:
    """start <= key < end; either may be absent."""
    if start is not None:
        df = df.where(F.col("key") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("key") < F.lit(end))
    return df


def scan(log: DataFrame, start=None, end=None, before: int | None = None) -> DataFrame:
    """Live entries of a key range, unordered; add ``orderBy("key")`` where order counts."""
    return latest(between(log, start, end), before)


def scan_prefix(log: DataFrame, prefix, before: int | None = None) -> DataFrame:
    return latest(log.where(F.startswith(F.col("key"), F.lit(prefix))), before)


def get(log: DataFrame, key, before: int | None = None) -> DataFrame:
    """No row or one."""
    return latest(log.where(F.col("key") == F.lit(key)), before)


def compact(log: DataFrame, retain: int | None = None) -> DataFrame:
    """The log without what no reader needs: the newest version of each key, without
    deletions, sequence numbers kept.  With ``retain``, snapshots from that number on
    still read the same: all versions from it on stay, and below it the newest."""
    if retain is None:
        return latest(log)
    return log.where(F.col("seq") >= retain).select("key", "seq", "value").unionByName(latest(log, retain))


def segment_stats(log: DataFrame, segment: Column) -> DataFrame:
    """Per segment: entries, deletions, least and greatest sequence number and key."""
    return log.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("value").isNull()).alias("deletions"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
    )


def overlay(base: DataFrame, buffer: DataFrame) -> DataFrame:
    """``base`` (key, value) as a transaction with ``buffer`` (key, value) sees it: the
    buffer wins, and its null deletes."""
    buffer = buffer.select(F.col("key").alias("buffered_key"), F.col("value").alias("buffered"))
    both = base.select("key", "value").join(buffer, F.col("key") == F.col("buffered_key"), "full_outer")
    mine = F.col("buffered_key").isNotNull()
    value = F.when(mine, F.col("buffered")).otherwise(F.col("value"))
    return both.select(F.coalesce("buffered_key", "key").alias("key"), value.alias("value")).where(F.col("value").isNotNull())


def last_writes(ops: DataFrame) -> DataFrame:
    """A buffer from numbered operations (key, op, value): the last per key."""
    return ops.groupBy("key").agg(F.max_by("value", "op").alias("value"))


def committed(log: DataFrame, buffer: DataFrame, seq: int) -> DataFrame:
    """The log after a commit: all of the buffer at one sequence number."""
    return log.select("key", "seq", "value").unionByName(buffer.select("key", F.lit(seq).cast("long").alias("seq"), "value"))


def without_prefix(log: DataFrame, prefix, seq: int) -> DataFrame:
    """Deletions, at ``seq``, of all live keys with a prefix."""
    return scan_prefix(log, prefix).select("key", F.lit(seq).cast("long").alias("seq"), F.lit(None).cast(log.schema["value"].dataType).alias("value"))


def without_range(log: DataFrame, start, end, seq: int) -> DataFrame:
    """Deletions, at ``seq``, of all live keys of a range; start inclusive, end exclusive."""
    return scan(log, start, end).select("key", F.lit(seq).cast("long").alias("seq"), F.lit(None).cast(log.schema["value"].dataType).alias("value"))
