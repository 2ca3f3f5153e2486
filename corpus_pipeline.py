"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again before the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, langid, ngram_join, packing, suffix_dedup
from cairn.llm.common import fresh, rest, stage

#: Shortest repeated passage, in bytes, that the suffix stage removes: well under fifty
#: words of running text, well over what independent texts share by chance.
PASSAGE_BYTES = 150
SEQUENCE = 4096


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text in any language: null, empty, no letters.

    The language is predicted from the text by a model of the labelled rows and takes
    the place of the label.  Where no row has a label no language is known; documents
    with letters stay, with a null label.  Ids don't matter here: null and repeated ones
    stay.  An empty table stays empty; extra columns, whatever their names, stay as well.
    """
    rest(spark)
    found, score = fresh(docs, "_language"), fresh(docs, "_language_score")
    model = langid.train(docs)
    if not model.languages:
        return docs.where("text RLIKE '\\\\p{L}'")
    out = langid.predict(docs, model, keep=[c for c in docs.columns if c != "doc_id"], named=(found, score))
    return out.where(F.col(found) != langid.UNKNOWN).withColumn("lang", F.col(found)).select(*[f"`{c}`" for c in docs.columns])


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id, stays; null
    ids give way to any other, and of rows equal in id and text any one stays.  Null
    text equals empty text.  Extra columns stay; an empty table stays empty."""
    rest(spark)
    return exact_dedup.keep_distinct(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest id, stays
    (five-word shingles, similarity 0.8 or more).

    Rows are told apart by id and text, so of rows that repeat an id each is judged by
    its own text.  Null ids give way to any other.  Of rows equal in id and text one
    stays, unless they have no words: null and wordless texts have no near copies and all
    stay.  Extra columns stay; an empty table stays empty.
    """
    rest(spark)
    key, words = fresh(docs, "_key"), fresh(docs, "_words")
    name = lambda text_id, i: F.concat_ws(":", F.hex(text_id), F.coalesce(i.cast("string"), F.lit("null")))
    rows = stage(ngram_join.link(docs, words=5, percent=80, with_rows=True).select(name(F.col("text_id"), F.col("doc_id")).alias(key), F.col("n_shingles").alias(words), "stays"), "linked")
    stays = rows.where("stays").select(key, words).distinct()
    text_id = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)
    out = docs.withColumn(key, name(text_id, F.col("doc_id"))).join(stays.hint("merge"), key)
    if rows.where(F.col(words) > 0).groupBy(key).count().where("count > 1").head(1):
        turn = fresh(docs, "_turn")
        out = out.withColumn(turn, F.when(F.col(words) > 0, 0).otherwise(F.monotonically_increasing_id())).dropDuplicates([key, turn]).drop(turn)
    return out.drop(key, words)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out of the text; a
    document of which only white space is left by that goes.

    Rows that share an id don't count against each other, a null id counts as the
    largest.  Null, empty and untouched texts stay as they are.  Extra columns stay; an
    empty table stays empty.
    """
    rest(spark)
    columns, (own_id, own_sha, kept) = docs.columns, (fresh(docs, x) for x in ("_id", "_sha", "_kept"))
    cut = suffix_dedup.remove_repeats(docs, PASSAGE_BYTES, with_text=True)
    cut = cut.where("n_removed > 0").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha), F.col("kept").alias(kept))
    cut = stage(cut.dropDuplicates([own_id, own_sha]), "cut")
    same = docs["doc_id"].eqNullSafe(cut[own_id]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == cut[own_sha])
    out, changed = docs.join(cut.hint("merge"), same, "left"), F.col(own_sha).isNotNull()
    out = out.withColumns({"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))})
    return out.where(~changed | F.col("text").rlike(r"\S")).select(*[f"`{c}`" for c in columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens with their sequence and place there.  Every row is
    packed, null text as its end id alone; an empty table gives no pieces."""
    rest(spark)
    return packing.pack_documents(docs, SEQUENCE)


STAGES = [("language_id", language_id), ("exact_dedup", drop_exact), ("ngram_jaccard", drop_near), ("suffix_dedup", drop_passages), ("best_fit_packing", pack)]

#: Language identification isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
