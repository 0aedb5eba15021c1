"""Anchor metrics and repeated blocks of a page, from exploded rows or from a page's arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config


def is_generic(text: Column) -> Column:
    """Whether a text says nothing of what it leads to, whatever stops and spaces follow."""
    return F.regexp_replace(F.lower(text), r"[.!?\s]+$", "").isin(*config.GENERIC_ANCHORS)


def anchor_counts(anchors) -> Column:
    """Counts over one page's anchors as a struct, without leaving the row."""
    a = F.col(anchors) if isinstance(anchors, str) else anchors
    inside, outside = F.filter(a, lambda x: x["is_internal"]), F.filter(a, lambda x: ~x["is_internal"])
    empty = F.filter(inside, lambda x: F.length(F.trim(x["text"])) < config.ANCHOR_LEAST)
    generic = F.filter(a, lambda x: (F.length(F.trim(x["text"])) >= config.ANCHOR_LEAST) & is_generic(x["text"]))
    href = lambda x: x["href"]
    return F.struct(
        F.size(inside).alias("internal"), F.size(outside).alias("external"),
        F.size(F.array_distinct(F.transform(inside, href))).alias("unique_internal"), F.size(F.array_distinct(F.transform(outside, href))).alias("unique_external"),
        F.size(empty).alias("empty_internal"), F.slice(F.transform(empty, href), 1, config.SAMPLES).alias("empty_samples"),
        F.size(generic).alias("generic"), F.slice(F.array_distinct(F.transform(generic, lambda x: x["text"])), 1, config.SAMPLES).alias("generic_samples"),
    )


def ambiguous_anchors(pages: DataFrame, key: list[str], anchors: str = "anchors") -> DataFrame:
    """key, text, destinations: texts, neither empty nor generic, that lead to several internal pages; of each page the first few by position."""
    rows = pages.select(*key, F.posexplode(anchors).alias("pos", "a")).filter("a.is_internal").select(*key, "pos", F.lower("a.text").alias("text"), "a.href")
    rows = rows.filter((F.length(F.trim("text")) >= config.ANCHOR_LEAST) & ~is_generic(F.col("text")))
    firsts = rows.groupBy(*key, "text", "href").agg(F.min("pos").alias("pos"))
    groups = firsts.groupBy(*key, "text").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "href"))).alias("d")).filter(F.size("d") >= config.AMBIGUOUS_LEAST)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    shown = F.slice(F.transform("d", lambda x: x["href"]), 1, config.SAMPLES)
    return groups.withColumn("rank", rank).filter(F.col("rank") <= config.SAMPLES).select(*key, "text", shown.alias("destinations"), "rank")


def repeated_blocks(blocks: DataFrame, key: list[str], pos: str = "pos", block: str = "block") -> DataFrame:
    """key, text, occurrences, rank: blocks that stand twice or more; of each page the most frequent, earlier ones first."""
    long = blocks.filter(F.length(block) >= config.BLOCK_LEAST)
    groups = long.groupBy(*key, block).agg(F.count("*").alias("occurrences"), F.min(pos).alias("first_pos")).filter("occurrences >= 2")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("occurrences"), "first_pos"))
    shown = F.when(F.length(block) > config.BLOCK_SHOWN, F.concat(F.substring(block, 1, config.BLOCK_SHOWN), F.lit("…"))).otherwise(F.col(block))
    return groups.withColumn("rank", rank).filter(F.col("rank") <= config.SAMPLES).select(*key, shown.alias("text"), "occurrences", "rank")
