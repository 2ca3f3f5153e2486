"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised
text.  A batch is reduced to one row per digest, a sort-merge anti-join against the
index finds the digests that are new, and those are appended.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import fresh, own_columns, shared_dir, stage
from cairn.llm.skew import join_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z in lower case, all else untouched."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class DigestIndex:
    """The stored digests: ``digest BINARY, keep_id BIGINT, batch STRING``, one row per digest.

    The number of buckets is fixed when the index is made and kept beside it, so any later
    session reads it with the same; asking for another number raises.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or shared_dir(spark, "digests")).rstrip("/")
        stored = self._stored_buckets()
        if stored is None:
            stored = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(stored).alias("buckets")).coalesce(1).write.parquet(f"{self.path}-layout")
        elif buckets not in (None, stored):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored
        self.table = "cairn_digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {stored} BUCKETS LOCATION '{self.path}'"
        )

    def _stored_buckets(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.path}-layout").first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        return groups.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """One file per bucket and call, each sorted by digest."""
        rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts of the batch the largest id stays, unless the index has the text
    from an earlier batch: then that id stays and none of these.  group_size counts
    the batch.  Null text equals empty text.  Of rows that repeat both id and text
    exactly one is kept; a null id gives way to any other.  An empty table gives an
    empty result.  Other columns are ignored, whatever their names.

    ``batch`` names the batch, by default after its rows' ids and texts.  A batch that is
    given again, because what followed it failed, gets its first answer again.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = own_columns(docs, doc_id=id_col, text=text_col)
    rows = stage(rows.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    # the sums don't depend on the order of rows; two seeds make 128 bits
    number = [F.sum(F.xxhash64(F.lit(seed), "doc_id", "digest").cast("decimal(38,0)")) for seed in (1, 2)]
    total, *sums = rows.agg(F.count(F.lit(1)), *number).first()
    batch = batch or f"{total}:{sums[0]}:{sums[1]}"
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(groups.select("digest", F.col("keep.doc_id").alias("batch_id"), F.col("keep.row").alias("batch_row"), "group_size"), "groups")
    stored = index.rows().select("digest", F.col("keep_id").alias("old_id"), F.col("batch").alias("old_batch"))
    groups = groups.join(stored.hint("merge"), "digest", "left")
    own = F.col("old_batch").isNull() | (F.col("old_batch") == batch)
    groups = stage(groups.withColumn("new", own).withColumn("keep_id", F.when(own, F.col("batch_id")).otherwise(F.col("old_id"))).drop("old_id", "old_batch"), "resolved")
    index.append(index.unseen(groups.where("new")).select("digest", "keep_id", F.lit(batch).alias("batch")))
    kept = F.col("new") & (F.col("row") == F.col("batch_row"))
    return join_groups(rows, groups, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``deduplicate``).

    Whole rows move once, to the short list of rows that stay; the key of that join has
    the id, so that a hot text's rows don't meet in one task.
    """
    key = fresh(docs, "_key")
    name = lambda sha, i: F.concat_ws(":", sha, F.coalesce(i.cast("string"), F.lit("null")))
    found = deduplicate(docs, index, batch=batch)
    stays = stage(found.where("kept").select(name(F.col("text_sha256"), F.col("doc_id")).alias(key)), "stays")
    again = found.groupBy(name(F.col("text_sha256"), F.col("doc_id"))).count().where("count > 1")
    out = docs.withColumn(key, name(F.sha2(normalised(F.col("`text`")), 256), F.col("`doc_id`"))).join(stays.hint("merge"), key, "left_semi")
    if again.head(1):  # rows that repeat both id and text
        out = out.dropDuplicates([key])
    return out.drop(key)
