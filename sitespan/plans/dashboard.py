"""The dashboard's queries as functions of tables; `now` is always an argument."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..operators import history

RECENT = 30


def label(table: dict[str, str], c) -> Column:
    """Name shown for a code; the code itself if it has none; a dash for nothing."""
    v = F.col(c) if isinstance(c, str) else c
    names = F.create_map(*map(F.lit, chain.from_iterable(table.items())))
    return F.when(F.coalesce(v, F.lit("")) == "", "—").otherwise(F.coalesce(F.try_element_at(names, v), v))


def severity_rank(c="severity") -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*(F.when(v == s, r) for s, r in config.SEVERITIES.items()), F.lit(4))


def list_sites(sites: DataFrame) -> DataFrame:
    return sites.select("id", "name", "domain", "base_url", "last_successful_crawl_at").orderBy("name")


def by_id(rows: DataFrame, value, column: str = "id") -> DataFrame:
    """Point lookup."""
    return rows.filter(F.col(column) == value)


def latest_run(runs: DataFrame, site) -> DataFrame:
    return runs.filter(F.col("site_id") == site).orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def active_run(runs: DataFrame, site) -> DataFrame:
    return latest_run(runs.filter("status = 'running'"), site)


def previous_run(runs: DataFrame) -> DataFrame:
    """Each run with the site's run before it, of any status."""
    w = Window.partitionBy("site_id").orderBy("started_at", "id")
    return runs.select("id", "site_id", F.lag("id").over(w).alias("previous_id"))


def newest(rows: DataFrame, per: list[str], at: str = "created_at", n: int = RECENT) -> DataFrame:
    """The newest n rows of each key; with no key, a plain ordered limit."""
    if not per:
        return rows.orderBy(F.desc(at), F.desc("id")).limit(n)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(at), F.desc("id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def changes_by_crawl(changes: DataFrame) -> DataFrame:
    s = history.summary(changes, "run_id").select("run_id", "new_issues", "resolved_issues", "changed_pages")
    return s.withColumn("total", F.col("new_issues") + F.col("resolved_issues") + F.col("changed_pages"))


def crawl_history(runs: DataFrame, changes: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest n runs of each site with their change counts; only those runs' changes are counted."""
    top = newest(runs, ["site_id"], "started_at", n)
    counts = changes_by_crawl(changes.join(top.select(F.col("id").alias("run_id")), "run_id", "left_semi"))
    d = top.join(counts.withColumnRenamed("run_id", "id"), "id", "left")
    return d.fillna(0, ["new_issues", "resolved_issues", "changed_pages", "total"])


def recent_changes(changes: DataFrame, site, limit: int = 50, event_type: str | None = None, severity: str | None = None) -> DataFrame:
    d = changes.filter(F.col("site_id") == site)
    d = d.filter(F.col("event_type") == event_type) if event_type else d.filter("event_type != 'issue_ongoing'")
    return newest(d.filter(F.col("severity") == severity) if severity else d, [], n=limit)


def in_category(changes: DataFrame, category: str) -> DataFrame:
    """Of rows already limited, those of a category. The limit stays below the filter."""
    return changes.filter(F.col("event_type").isin(*config.EVENT_CATEGORIES[category]))


def issues_by_severity_text(issues: DataFrame, run) -> DataFrame:
    return issues.filter(F.col("run_id") == run).orderBy("severity")


def worst_first(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_rank(), F.expr("collate(url, 'UNICODE')"))


def overall_status(critical, high, unexpected_noindex, http_failures, new_issues) -> Column:
    return F.when((critical > 0) | (unexpected_noindex > 0) | (http_failures > 0), "critical").when((high > 0) | (new_issues > 0), "needs_attention").otherwise("healthy")


def freshness(at: Column, now: Column, stale_hours: float) -> Column:
    """Minutes since a crawl (not below 0, half up) and whether that is too long; null for no crawl."""
    seconds = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(at.cast("timestamp")) / 1e6
    minutes = F.greatest(F.lit(0), F.floor(seconds / 60 + 0.5))
    return F.when(at.isNotNull(), F.struct(minutes.alias("minutes_ago"), (minutes > stale_hours * 60).alias("is_stale")))


def latest_crawl(runs: DataFrame, issues: DataFrame, changes: DataFrame, scores: DataFrame, pages: DataFrame, now: Column, stale_hours: float = config.DEFAULTS["freshness_hours"]) -> DataFrame:
    """For each site its latest run with changes, score, status and freshness (from its end, or else its start); all null while it runs."""
    from .views import latest_runs

    r = latest_runs(runs)
    flag = lambda when, name: F.when(when, 1).otherwise(0).alias(name)
    none = lambda *names: [F.lit(0).alias(n) for n in names]
    i = issues.select(F.col("run_id").alias("id"), flag(F.col("severity") == "critical", "critical"), flag(F.col("severity") == "high", "high"), *none("unexpected"))
    p = pages.select(F.col("run_id").alias("id"), *none("critical", "high"), flag(F.col("indexing_state") == "noindex_unexpected", "unexpected"))
    # Both in one aggregate: each more of them, with its join, would hold its own rows in the memory of the same task.
    n = i.unionByName(p).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("critical", "high", "unexpected")))
    s = history.summary(changes, "run_id").withColumnRenamed("run_id", "id")
    d = r.join(n, "id", "left").join(s, "id", "left").join(scores.select(F.col("run_id").alias("id"), "overall_score"), "id", "left")
    counts = ["critical", "high", "unexpected", "new_issues", "resolved_issues", "ongoing_issues", "new_pages", "removed_pages", "changed_pages"]
    d = d.fillna(0, counts)
    done = F.col("status") != "running"
    status = overall_status(F.col("critical"), F.col("high"), F.col("unexpected"), F.lit(0), F.col("new_issues"))
    return d.select("site_id", "id", "status", *(F.when(done, F.col(c)).alias(c) for c in [*counts, "overall_score"]), F.when(done, status).alias("overall_status"), F.when(done, freshness(F.coalesce("finished_at", "started_at"), now, stale_hours)).alias("freshness"))


def crawl_detail(runs: DataFrame, changes: DataFrame, run) -> DataFrame:
    """One run with the run before it and its summary; zeros without changes."""
    d = runs.filter(F.col("id") == run).join(previous_run(runs).select("id", "previous_id"), "id")
    s = history.summary(changes.filter(F.col("run_id") == run), "run_id").withColumnRenamed("run_id", "id")
    return d.join(s, "id", "left").fillna(0, ["new_issues", "resolved_issues", "ongoing_issues", "new_pages", "removed_pages", "changed_pages"])


def pages_with_issue_counts(pages: DataFrame, issues: DataFrame, key: list[str]) -> DataFrame:
    n = issues.groupBy(*key).agg(F.count("*").alias("issue_count"))
    return pages.join(n, key, "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))


def crawl_events(changes: DataFrame, run) -> DataFrame:
    """The change events of one run, as its detail view lists them."""
    return changes.filter(F.col("run_id") == run)


def page_detail(pages: DataFrame, issues: DataFrame, changes: DataFrame, runs: DataFrame, url: str | None = None, n: int = RECENT) -> DataFrame:
    """Latest pages (site_id, run_id, url, ...) with their current issues, newest n changes and the run's preferred host: of one url, or of all.

    Issues come by type, as many as a page has; changes come newest first and
    are cut to n in each task before they move. Pages without any have empty lists.
    """
    at = ["site_id", "url"]
    if url is not None:
        pages, issues, changes = (d.filter(F.col("url") == url) for d in (pages, issues, changes))
    i = issues.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("issue_type", "severity", "issue_key"))).alias("issues"))
    c = newest(changes, at, n=n).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "event_type", "created_at"))).alias("changes"))
    host = runs.select(F.col("id").alias("run_id"), "preferred_host")
    d = pages.join(i, at, "left").join(c, at, "left").join(host, "run_id", "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind.schema[name].dataType))
    return d.withColumns({"issues": none("issues", i), "changes": none("changes", c)})


# --- what the pages of the dashboard do with rows already fetched ------------


def search_issues(issues: DataFrame, query: str = "", severity: str | None = None, issue_type: str | None = None, page_type: str | None = None) -> DataFrame:
    d = issues
    for c, v in (("severity", severity), ("issue_type", issue_type), ("page_type", page_type)):
        d = d.filter(F.col(c) == v) if v else d
    text = F.lower(F.concat_ws(" ", "url", "issue_type", *(["message"] if "message" in d.columns else [])))
    return d.filter(F.contains(text, F.lit(query.lower()))) if query else d


def sort_issues(issues: DataFrame, by: str = "severity", descending: bool = False) -> DataFrame:
    """By severity rank, then URL; by URL; or by first_seen_at (nothing counts as the epoch). Descending turns all keys round."""
    keys = {"severity": [severity_rank(), F.col("url")], "url": [F.col("url")], "first_seen": [F.coalesce(F.unix_micros(F.col("first_seen_at").cast("timestamp")), F.lit(0)) if by == "first_seen" else F.lit(0)]}[by]
    return issues.orderBy(*(k.desc() if descending else k.asc() for k in keys))


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("value")).filter("value is not null and value != ''").distinct().orderBy("value")


def search_pages(pages: DataFrame, query: str = "", page_type: str | None = None, indexing_state: str | None = None) -> DataFrame:
    d = pages
    for c, v in (("page_type", page_type), ("indexing_state", indexing_state)):
        d = d.filter(F.col(c) == v) if v else d
    return d.filter(F.contains(F.lower(F.concat_ws(" ", "url", "title")), F.lit(query.lower()))) if query else d


def trend(history_rows: DataFrame, per: str = "site_id") -> DataFrame:
    """Rows in time order, for keys that have two or more, scaled to the greatest value (1 at least)."""
    w = Window.partitionBy(per)
    d = history_rows.withColumn("points", F.count("*").over(w)).filter("points >= 2")
    order = F.row_number().over(w.orderBy("started_at", "id"))
    return d.withColumns({"position": order, "height": F.col("value") / F.greatest(F.lit(1), F.max("value").over(w))})


def meaningful_total() -> Column:
    return F.col("new_issues") + F.col("resolved_issues") + F.col("new_pages") + F.col("removed_pages") + F.col("changed_pages")


def duration_seconds(started: Column, finished: Column) -> Column:
    return F.floor((F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6 + 0.5)


def top_deductions(penalties: DataFrame, run: str = "run", n: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("penalty"), "issue_type"))
    return penalties.filter("penalty > 0").withColumn("rank", rank).filter(F.col("rank") <= n)


def type_of_key(key="issue_key") -> Column:
    return F.get(F.split(key, "::"), F.lit(1))


def stage_progress(stage: Column, shown: Column) -> Column:
    """done, active or pending for a shown stage, by its place in the order of stages."""
    order = F.array(*map(F.lit, config.STAGES))
    now, at = F.call_function("array_position", order, stage), F.call_function("array_position", order, shown)
    return F.when(at < now, "done").when(at == now, "active").otherwise("pending")


def kilobytes(bytes_: Column) -> Column:
    return F.coalesce(F.floor(bytes_ / 1024 + 0.5).cast("string"), F.lit("not recorded"))


def width_verdict(px: Column, most: int) -> Column:
    return F.when(px.isNull(), "not recorded").when(px > most, "wide").otherwise("ok")


def selected_site(current: Column, remembered: Column, first: Column) -> Column:
    return F.coalesce(current, remembered, first)
