"""The stored tables' views and snapshot writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import issue_key


def latest_runs(runs: DataFrame, only_success: bool = False) -> DataFrame:
    """The latest run of each site by start, then id; of any status unless told. Combines before it moves."""
    d = runs.filter("status = 'success'") if only_success else runs
    rest = [c for c in runs.columns if c != "site_id"]
    return d.groupBy("site_id").agg(F.max_by(F.struct(*rest), F.struct("started_at", "id")).alias("r")).select("site_id", "r.*").select(*runs.columns)


def issue_occurrences(issues: DataFrame, runs: DataFrame) -> DataFrame:
    r = runs.select(F.col("id").alias("run_id"), F.col("started_at").alias("crawl_started_at"))
    return issues.select("site_id", "issue_key", "run_id").join(r, "run_id")


def issue_history(occurrences: DataFrame) -> DataFrame:
    t = F.col("crawl_started_at")
    return occurrences.groupBy("site_id", "issue_key").agg(F.min(t).alias("first_seen_at"), F.max(t).alias("last_seen_at"), F.count("*").alias("times_seen"))


def current_issues(issues: DataFrame, runs: DataFrame, page_types: DataFrame | None = None) -> DataFrame:
    """Issues of each site's latest run with their history, and page_type where page_types (run_id, url, page_type) knows it.

    History is counted only for the keys that are current.
    """
    latest = latest_runs(runs).select(F.col("id").alias("run_id"))
    now = issues.join(latest, "run_id", "left_semi")
    keys = now.select("site_id", "issue_key").distinct()
    history = issue_history(issue_occurrences(issues.join(keys, ["site_id", "issue_key"], "left_semi"), runs))
    d = now.join(history.drop("last_seen_at"), ["site_id", "issue_key"], "left")
    return d.join(page_types, ["run_id", "url"], "left") if page_types is not None else d


def latest_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    return pages.join(latest_runs(runs).select(F.col("id").alias("run_id")), "run_id", "left_semi")


def latest_scores(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Score snapshots of each site's latest successful run."""
    return scores.join(latest_runs(runs, True).select(F.col("id").alias("run_id")), "run_id", "left_semi")


def issue_snapshots(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues with their key and the snapshot of the page with the very same url."""
    ids = pages.groupBy("run_id", "url").agg(F.max("id").alias("page_snapshot_id"))
    return issues.withColumn("issue_key", issue_key("url", "issue_type")).join(ids, ["run_id", "url"], "left")


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows, those of the new keys replaced."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def sites_with(stored: DataFrame, urls_: DataFrame, host) -> DataFrame:
    """Stored sites and one new row for each host that they lack."""
    new = urls_.select(host.alias("domain")).filter("domain is not null").distinct().join(stored.select("domain"), "domain", "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def latest_state(events: DataFrame) -> DataFrame:
    """Run lifecycle from its events (run_id, seq, status, stage, at): the last of each, with the first and last time."""
    return events.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("stage", "seq").alias("stage"), F.min("at").alias("started_at"), F.max("at").alias("last_progress_at"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON."""
    report.write.mode("overwrite").json(path)
