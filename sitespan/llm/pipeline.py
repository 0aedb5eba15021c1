"""A corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents, each over all that the stage before it kept.
Empty tables give empty results; columns beside those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, neardup, packing, pii, repetition
from .common import held_out, scratch, stored, table
from .queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts pass the repetition rules; null and empty texts do not. Each row is judged by itself; an empty table gives none, and other columns pass through."""
    return repetition.filtered(docs, "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is at least half sure of; texts without a letter go. Each row is judged by itself; an empty table gives none, and other columns pass through."""
    return langid.kept(docs, langid.train(docs, ~held_out("doc_id", 5, 0)), "text", 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; texts without words are no duplicates.

    Rows are decided one by one: where ids are null or repeat, rows get a key of
    their own beforehand, and unlike texts under one id all stay.
    """
    one_each = docs.agg(F.count("*") == F.count("doc_id")).first()[0] and not docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    key = "doc_id"
    if not one_each:
        while key in docs.columns:
            key += "_"
        docs = stored(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-keyed")  # written, so that the keys stand
    found = neardup.near_duplicates(docs, id_col=key)
    if one_each:
        go = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_row"))
    else:  # the smallest id of a group stays, whatever its row's key
        ids = found.select(F.col("doc_id").alias("_row"), "component_id").join(docs.select(F.col(key).alias("_row"), F.col("doc_id").alias("_id")), "_row")
        first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"].alias("_first"))
        go = ids.join(first, "component_id").filter("_row != _first").select("_row")
    go = stored(go, "pipeline-duplicates")
    out = docs.join(neardup.bounded(go), docs[key] == go["_row"], "left_anti")
    return out if one_each else out.drop(key)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; null texts stay null."""
    out = pii.masked(docs, "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 4096 tokens. Null and empty texts are their end mark; ids may repeat."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("quality rules", quality),
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what a stage leaves in the shared folder goes when the next has its rows."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "pipeline")
        return keep(stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline"))
