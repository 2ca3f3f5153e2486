"""Secondary indexes, derived from the documents and so always in step with them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.values import value_text

NULL_TEXT = "null"


def index(docs: DataFrame, value: Column, id_col: str = "_id") -> DataFrame:
    """id and value of every document, null and missing as 'null'."""
    return docs.select(F.col(id_col).alias("id"), value_text(value).alias("value"))


def lookup(docs: DataFrame, value: Column, wanted: str, prefix: bool = False) -> DataFrame:
    """The documents an index read finds: by the whole text of the value, or by its
    beginning.  On strings and whole numbers it is a comparison of the value itself, by
    which the scan skips files and row groups; on other types one of its text."""
    kind = docs.select(value).schema.fields[0].dataType
    if isinstance(kind, T.StringType):
        found = F.startswith(value, F.lit(wanted)) if prefix else value == F.lit(wanted)
    elif isinstance(kind, T.IntegralType) and not prefix:
        # only the one way in which a number is written can be its text
        number = re.fullmatch(r"0|-?[1-9][0-9]{0,18}", wanted)
        found = value == F.lit(int(wanted)) if number and -(1 << 63) <= int(wanted) < 1 << 63 else F.lit(False)
    else:
        text = value_text(value)
        return docs.where(F.startswith(text, F.lit(wanted)) if prefix else text == F.lit(wanted))
    # null and missing are indexed as 'null'
    return docs.where(found | value.isNull() if (NULL_TEXT.startswith(wanted) if prefix else wanted == NULL_TEXT) else found)


def fetch(entries: DataFrame, docs: DataFrame, id_col: str = "_id") -> DataFrame:
    """Documents of index entries; entries without a document find none."""
    return docs.join(entries.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")


def violations(batch: DataFrame, existing: DataFrame, value: Column, id_col: str = "_id") -> DataFrame:
    """Rows that a unique index turns away: a smaller id of the batch, or a stored
    document of another id, has the value already.  Of each value only the least id is
    needed, so the values are aggregated and joined, never sorted within a group."""
    first = batch.groupBy(value_text(value).alias("value")).agg(F.min(id_col).alias("first_id"))
    stored = existing.groupBy(value_text(value).alias("value")).agg(F.min(id_col).alias("low"), F.max(id_col).alias("high"))
    found = batch.withColumn("value", value_text(value)).join(first, "value").join(stored, "value", "left")
    taken = (F.col(id_col) != F.col("low")) | (F.col(id_col) != F.col("high"))
    return found.where((F.col(id_col) != F.col("first_id")) | F.coalesce(taken, F.lit(False))).select(*[F.col(c) for c in batch.columns], "value")
