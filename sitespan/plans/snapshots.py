"""Stored snapshots of runs: their shape, writes that may be repeated, and scores rebuilt from them.

Tables are Parquet, partitioned by run. A write replaces the partitions of the
runs it holds and no others, so a job that is started again leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import issue_key, normalized_or_raw
from ..lineage import remove
from ..operators import scoring

RUN = "crawl_run_id"
LINKS = "struct<internal:int,unique_internal:int,external:int,unique_external:int>"

#: Stored column, its source among the columns of analyzed pages, and its type.
PAGE_COLUMNS = [
    ("url", "url", "string"), ("final_url", "final_url", "string"), ("page_ord", "ord", "long"), ("status_code", "status", "int"), ("redirect_count", "redirect_count", "int"), ("response_time_ms", "response_time_ms", "int"),
    ("page_type", "page_type", "string"), ("publication_state", "publication_state", "string"), ("indexing_state", "indexing_state", "string"), ("is_indexable", "is_indexable", "boolean"),
    ("title", "title", "string"), ("title_length", "title_length", "int"), ("meta_description", "meta_description", "string"), ("meta_description_length", "meta_description_length", "int"), ("canonical", "canonical", "string"),
    ("h1_count", "h1_count", "int"), ("h2_count", "h2_count", "int"), ("word_count", "word_count", "int"), ("internal_inbound_link_count", "inbound", "long"), ("internal_outbound_link_count", "size(internal_links)", "int"),
    ("image_count", "images_total", "int"), ("images_missing_alt", "images_missing_alt", "int"), ("noindex", "noindex", "boolean"), ("nofollow", "nofollow", "boolean"), ("robots_meta", "robots", "string"), ("lang", "lang", "string"),
    ("has_viewport", "has_viewport", "boolean"), ("has_favicon", "has_favicon", "boolean"), ("source_sitemap", "in_sitemap", "boolean"), ("source_discovered", "discovered", "boolean"),
    ("structured_data", "structured_types", "array<string>"), ("structured_data_details", "episodes", "array<struct<type:string,date_published:string,date_modified:string,episode_number:string,name:string,url:string>>"),
    ("open_graph", "open_graph", "struct<title:string,description:string,image:string>"), ("twitter", "twitter", "struct<card:string,title:string,description:string,image:string>"),
    ("html_size_bytes", "html_size_bytes", "int"), ("charset", "charset", "string"), ("has_html5_doctype", "has_doctype", "boolean"), ("compression_encoding", "compression", "string"),
    ("internal_link_count", "metrics.internal", "int"), ("unique_internal_link_count", "metrics.unique_internal", "int"), ("external_link_count", "metrics.external", "int"), ("unique_external_link_count", "metrics.unique_external", "int"),
    ("title_pixel_width_estimate", "title_px", "int"), ("meta_description_pixel_width_estimate", "meta_description_px", "int"), ("mixed_content_count", "mixed_content_count", "int"),
    ("alternate_links", "alternate_links", "array<struct<hreflang:string,href:string>>"), ("headings", "headings", "array<struct<level:int,text:string>>"), ("server_headers", "server_headers", "struct<server:string,x_powered_by:string,content_type:string,cache_control:string,content_security_policy:string,strict_transport_security:string>"),
]


def _row_id(*parts) -> Column:
    """An id that a repeated write gives again."""
    return F.sha2(F.to_json(F.struct(*(F.col(p).cast("string").alias(f"k{i}") for i, p in enumerate(parts)))), 256)


def page_rows(pages: DataFrame, runs: DataFrame, run: str = "run") -> DataFrame:
    """Crawled pages as they are stored. runs: id, site_id. What `pages` does not have is null: not recorded."""
    def source(expr: str, kind: str) -> Column:
        top = expr.removeprefix("size(").partition(".")[0].rstrip(")")
        there = top in pages.columns and ("." not in expr or expr.partition(".")[2] in pages.schema[top].dataType.names)
        return (F.expr(expr) if there else F.lit(None)).cast(kind)

    d = pages.withColumn(RUN, F.col(run)).join(runs.select(F.col("id").alias(RUN), "site_id"), RUN)
    return d.select(_row_id(RUN, "url", "ord").alias("id"), RUN, "site_id", normalized_or_raw("url").alias("normalized_url"), *(source(e, t).alias(n) for n, e, t in PAGE_COLUMNS))


def issue_rows(issues: DataFrame, pages: DataFrame, run: str = "run") -> DataFrame:
    """Issues as they are stored: with their key and the snapshot of the page with the very same url (the last of several), null without one. pages: page_rows."""
    ids = pages.groupBy(RUN, "url").agg(F.max_by("id", "page_ord").alias("page_snapshot_id"), F.first("site_id").alias("site_id"))
    d = issues.withColumn(RUN, F.col(run)).join(ids, [RUN, "url"], "left").withColumn("issue_key", issue_key("url", "issue_type"))
    has = lambda c: F.col(c) if c in issues.columns else F.lit(None).cast("string").alias(c)
    return d.select(_row_id(RUN, "url", "ord", "issue_type").alias("id"), RUN, "site_id", "page_snapshot_id", "url", "issue_key", "issue_type", "severity", *(has(c) for c in ("message", "recommendation", "value")), F.col("ord").cast("long").alias("ord"))


def change_rows(events: DataFrame, runs: DataFrame, created_at: Column, run: str = "pair") -> DataFrame:
    """Change events as they are stored. runs: id, site_id."""
    d = events.withColumn(RUN, F.col(run)).join(runs.select(F.col("id").alias(RUN), "site_id"), RUN)
    cols = ["event_type", "entity_type", "url", "issue_key", "severity", "field_name", "previous_value", "current_value"]
    return d.select(_row_id(RUN, *cols).alias("id"), RUN, "site_id", *cols, created_at.alias("created_at"))


CATEGORY_COLUMNS = {"technical": "technical_score", "onPage": "on_page_score", "content": "content_score", "internalLinks": "internal_linking_score", "indexing": "indexing_score", "performance": "performance_score"}


def score_rows(scores: DataFrame, runs: DataFrame, run: str = "run") -> DataFrame:
    """Scores as they are stored: rounded half up by category, in full in score_breakdown."""
    d = scores.withColumn(RUN, F.col(run)).join(runs.select(F.col("id").alias(RUN), "site_id"), RUN)
    whole = F.to_json(F.struct(*(F.col(f"score_{c}").alias(c) for c in CATEGORY_COLUMNS)))
    return d.select(RUN, "site_id", "overall_score", F.col("raw").alias("overall_score_raw"), *(F.floor(F.col(f"score_{c}") + 0.5).cast("int").alias(n) for c, n in CATEGORY_COLUMNS.items()), F.col("cap_applied").alias("safety_cap_applied"), whole.alias("score_breakdown"))


def write_runs(rows: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Store rows by run; what is stored of the same runs is replaced, other runs stay.

    runs: id of all runs that this write is about; those without rows are
    emptied. Rows are dealt out by run and evened, so a run of any size is
    written by several tasks.
    """
    spark = rows.sparkSession
    rows.hint("rebalance", RUN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(RUN).parquet(path)
    if runs is not None:
        for r in runs.select("id").join(rows.select(F.col(RUN).alias("id")).distinct(), "id", "left_anti").toLocalIterator():
            remove(spark, f"{path}/{RUN}={r.id}")


def stored_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stored rows with the columns of `like` (columns that older files lack are null); a filter on the run reads its files only."""
    return spark.read.schema(like.schema).parquet(path).select(like.columns)


def rebuilt_pages(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """What scores read of stored pages. Outcomes come from status codes; broken links from the value of their issue."""
    broken = issues.filter("issue_type = 'broken_internal_links' and page_snapshot_id is not null").groupBy(F.col("page_snapshot_id").alias("id")).agg(F.max(F.coalesce(F.size(F.from_json("value", "array<string>")), F.lit(0))).alias("n_broken"))
    d = pages.join(broken, "id", "left").fillna(0, ["n_broken"])
    return d.select(
        F.col(RUN).alias("run"), F.col("page_ord").alias("ord"), "url", F.coalesce("final_url", "url").alias("final_url"), F.col("status_code").alias("status"), scoring.inferred_outcome("status_code").alias("outcome"),
        "page_type", "indexing_state", F.coalesce("images_missing_alt", F.lit(0)).alias("images_missing_alt"), F.coalesce("has_viewport", F.lit(False)).alias("has_viewport"), "lang", "n_broken",
    )


def rebuilt_issues(issues: DataFrame) -> DataFrame:
    """Stored issues of stored pages; those without a page are left out."""
    return issues.filter("page_snapshot_id is not null").select(F.col(RUN).alias("run"), "url", "ord", "issue_type", "severity")


def backfilled(runs: DataFrame, pages: DataFrame, issues: DataFrame, scores: DataFrame, force: bool = False) -> DataFrame:
    """Score rows, with score_delta, of the successful runs that have none yet (of all with `force`), from their snapshots.

    runs: id, site_id, status, started_at; the others as stored. All runs are
    scored at once. A run's change is from the score that its site's run before
    has then, be it stored or new. Runs without pages get the score of an empty
    crawl.
    """
    todo = scoring.backfill(runs, scores.select(F.col(RUN).alias("run_id")), force).select("id", "site_id")
    ids = todo.select(F.col("id").alias(RUN))
    p, i = pages.join(ids, RUN, "left_semi"), issues.join(ids, RUN, "left_semi")
    made = scoring.scores(rebuilt_pages(p, i), rebuilt_issues(i))
    bare = todo.join(p.select(F.col(RUN).alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("run"))
    none = bare.join(F.broadcast(scoring.empty_score(runs.sparkSession)))  # one row
    new = score_rows(made.unionByName(none.select(made.columns)), runs)
    kept = scores.join(ids, RUN, "left_anti").select(RUN, "overall_score", F.lit(False).alias("_new"))
    order = runs.filter("status = 'success'").select(F.col("id").alias(RUN), "site_id", "started_at")
    before = F.lag("overall_score").over(Window.partitionBy("site_id").orderBy("started_at", RUN))
    line = kept.unionByName(new.select(RUN, "overall_score", F.lit(True).alias("_new"))).join(order, RUN)
    return new.join(line.withColumn("score_delta", F.col("overall_score") - before).filter("_new").select(RUN, "score_delta"), RUN)
