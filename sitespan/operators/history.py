"""Comparison of a crawl with the one before: full outer joins and arrays of conditional events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import collapsed
from ..functions.urls import normalized_or_raw


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def text_changed(a: Column, b: Column) -> Column:
    return collapsed(F.coalesce(a, F.lit(""))) != collapsed(F.coalesce(b, F.lit("")))


def url_changed(a: Column, b: Column) -> Column:
    shown = lambda u: F.when(u != "", normalized_or_raw(u))
    return differs(shown(a), shown(b))


def types_changed(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(a, none))) != F.array_sort(F.array_distinct(F.coalesce(b, none)))


def _far(a: Column, b: Column, delta: float, share: float) -> Column:
    d = F.abs(b - a)
    return (d >= delta) | F.coalesce(F.when(a > 0, d / a >= share), F.lit(False))


def words_changed(a: Column, b: Column) -> Column:
    return _far(a, b, config.WORDS_DELTA, config.WORDS_SHARE)


def inbound_changed(a: Column, b: Column) -> Column:
    return ((a > 0) & (b == 0)) | ((a == 0) & (b > 0)) | (F.abs(b - a) >= config.INBOUND_DELTA)


def links_changed(a: Column, b: Column) -> Column:
    return F.coalesce(((a > 0) & (b == 0)) | ((a == 0) & (b > 0)) | _far(a, b, config.LINKS_DELTA, config.LINKS_SHARE), F.lit(False))


def bytes_changed(a: Column, b: Column) -> Column:
    return F.coalesce(_far(a, b, config.BYTES_DELTA, config.BYTES_SHARE), F.lit(False))


def millis_changed(a: Column, b: Column) -> Column:
    d = F.abs(b - a)
    return F.coalesce((d >= config.MILLIS_DELTA) & F.when(a > 0, d / a >= config.MILLIS_SHARE).otherwise(False), F.lit(False))


def last_of(rows: DataFrame, key: list[str], ord_col: str) -> DataFrame:
    """One row a key, the last by order. Combines before it moves; no window."""
    rest = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(ord_col)).alias("r"))
    return one.select(*key, "r.*")


EVENT = "event_type string, entity_type string, url string, issue_key string, severity string, field_name string, previous_value string, current_value string"


def event(when: Column | None, kind: str, entity: str, url: Column, issue_key=None, severity=None, field: str | None = None, before=None, after=None) -> Column:
    s = lambda c: F.lit(None).cast("string") if c is None else F.lit(c) if isinstance(c, str) else c.cast("string")
    made = F.struct(
        F.lit(kind).alias("event_type"), F.lit(entity).alias("entity_type"), s(url).alias("url"), s(issue_key).alias("issue_key"), s(severity).alias("severity"),
        s(field).alias("field_name"), s(before).alias("previous_value"), s(after).alias("current_value"),
    )
    return made if when is None else F.when(when, made)


def exploded(joined: DataFrame, key: list[str], events: Column) -> DataFrame:
    return joined.select(*key, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(*key, "e.*")


def page_digests(pages: DataFrame, fields: list[str], key: str = "pair") -> DataFrame:
    """key, url_key, digest: one row a page, the last by order, with 128 bits over all compared fields. Equal rows have equal digests."""
    d = last_of(pages.select(key, "url_key", "ord", *fields), [key, "url_key"], "ord")
    shown = F.to_json(F.struct(*(F.col(f) for f in fields)), {"ignoreNullFields": "false"})
    return d.select(key, "url_key", F.md5(shown).alias("digest"))


def unlike(current: DataFrame, previous: DataFrame, key: str = "pair") -> DataFrame:
    """key, url_key of the pages whose digests differ or that one side lacks: what a comparison has to read in full."""
    both = current.withColumn("_now", F.lit(1)).unionByName(previous.withColumn("_now", F.lit(0)))
    d = both.groupBy(key, "url_key").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    return d.filter("n <> 2 or a <> b").select(key, "url_key")


def compare_issues(current: DataFrame, previous: DataFrame, key: str = "pair") -> DataFrame:
    """Events of two issue tables (pair, issue_key, url, severity, ord): new, ongoing (and severity changed), resolved. The last row of a key counts."""
    c, p = (last_of(x.select(key, "issue_key", "url", "severity", "ord"), [key, "issue_key"], "ord") for x in (current, previous))
    c, p = c.withColumn("here", F.lit(True)), p.withColumn("here", F.lit(True))
    j = c.alias("c").join(p.alias("p"), (F.col(f"c.{key}") == F.col(f"p.{key}")) & (F.col("c.issue_key") == F.col("p.issue_key")), "full")
    j = j.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), F.coalesce("c.issue_key", "p.issue_key").alias("k"), F.struct("c.*").alias("c"), F.struct("p.*").alias("p"))
    now, before = F.col("c.here").isNotNull(), F.col("p.here").isNotNull()
    k = F.col("k")
    return exploded(j, [key], F.array(
        event(now & ~before, "issue_new", "issue", F.col("c.url"), k, F.col("c.severity"), after=F.col("c.severity")),
        event(now & before & (F.col("c.severity") != F.col("p.severity")), "severity_changed", "issue", F.col("c.url"), k, F.col("c.severity"), before=F.col("p.severity"), after=F.col("c.severity")),
        event(now & before, "issue_ongoing", "issue", F.col("c.url"), k, F.col("c.severity"), after=F.col("c.severity")),
        event(~now & before, "issue_resolved", "issue", F.col("p.url"), k, F.col("p.severity"), before=F.col("p.severity")),
    ))


#: field, kind of event, predicate; both tables name the column alike. In order of emission, with the two flags at their place.
FIELDS = [
    ("status", "http_status_changed", differs), ("final_url", "field_changed", url_changed), ("title", "field_changed", text_changed), ("meta_description", "field_changed", text_changed),
    ("canonical", "canonical_changed", url_changed), ("h1_count", "field_changed", differs), ("word_count", "field_changed", words_changed), ("noindex", "field_changed", differs),
    ("is_indexable", "indexability_changed", differs), ("indexing_state", "indexing_state_changed", differs), ("publication_state", "publication_state_changed", differs),
    ("page_type", "field_changed", differs), ("in_sitemap", ("page_added_to_sitemap", "page_removed_from_sitemap"), None), ("discovered", ("page_became_discovered", "page_no_longer_discovered"), None),
    ("inbound", "field_changed", inbound_changed), ("html_size_bytes", "html_size_changed", bytes_changed), ("response_time_ms", "response_time_changed", millis_changed),
    ("internal_link_count", "link_count_changed", links_changed), ("external_link_count", "link_count_changed", links_changed), ("structured_types", "field_changed", types_changed),
]
STORED = {"status": "status_code", "in_sitemap": "source_sitemap", "discovered": "source_discovered", "inbound": "internal_inbound_link_count", "structured_types": "structured_data"}


def compare_changed_pages(current: DataFrame, previous: DataFrame, key: str = "pair", digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """compare_pages for tables that are stored: digests are compared first, and only pages that differ go through the wide join.

    digests: page_digests of both tables over compared_fields, if they were
    stored with them; else they are taken here, in one more reading of the
    compared columns. Titles, addresses and lists of unchanged pages do not move.
    """
    fields = compared_fields(current, previous)
    now, before = digests or (page_digests(current, fields, key), page_digests(previous, fields, key))
    todo = unlike(now, before, key)
    at = [key, "url_key"]
    return compare_pages(current.join(todo, at, "left_semi"), previous.join(todo, at, "left_semi"), key)


def compared_fields(current: DataFrame, previous: DataFrame) -> list[str]:
    return [f for f, _, _ in FIELDS if f in current.columns and f in previous.columns]


def compare_pages(current: DataFrame, previous: DataFrame, key: str = "pair") -> DataFrame:
    """Events of two page tables with pair, url_key, url, ord and any of the columns of FIELDS. The last row of a key counts."""
    have = [f for f in FIELDS if f[0] in compared_fields(current, previous)]
    cols = [key, "url_key", "url", "ord", *(f for f, _, _ in have)]
    c, p = (last_of(x.select(*cols), [key, "url_key"], "ord").withColumn("here", F.lit(True)) for x in (current, previous))
    j = c.alias("c").join(p.alias("p"), (F.col(f"c.{key}") == F.col(f"p.{key}")) & (F.col("c.url_key") == F.col("p.url_key")), "full")
    j = j.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), F.struct("c.*").alias("c"), F.struct("p.*").alias("p"))
    now, before = F.col("c.here").isNotNull(), F.col("p.here").isNotNull()
    url = F.col("c.url")
    events = [event(now & ~before, "page_new", "page", url)]
    for f, kind, test in have:
        a, b, name = F.col(f"p.{f}"), F.col(f"c.{f}"), STORED.get(f, f)
        if isinstance(kind, tuple):
            events.append(event(now & before & ~a & b, kind[0], "page", url, field=name, before="false", after="true"))
            events.append(event(now & before & a & ~b, kind[1], "page", url, field=name, before="true", after="false"))
        else:
            events.append(event(now & before & test(a, b), kind, "page", url, field=name, before=a, after=b))
    events.append(event(~now & before, "page_removed", "page", F.col("p.url")))
    return exploded(j, [key], F.array(*events))


def baseline_runs(runs: DataFrame) -> DataFrame:
    """run_id, baseline_id: the latest success of the site other than the run itself, by start, then id; null for a first crawl.

    Needs the two latest successes of a site only.
    """
    order = F.struct("started_at", "id")
    top = runs.filter("status = 'success'").groupBy("site_id").agg(F.max(order).alias("first"))
    second = runs.filter("status = 'success'").join(top, "site_id").filter(order != F.col("first")).groupBy("site_id").agg(F.max(order).alias("second"))
    d = runs.join(top, "site_id", "left").join(second, "site_id", "left")
    return d.select(F.col("id").alias("run_id"), F.when(F.col("first.id") == F.col("id"), F.col("second.id")).otherwise(F.col("first.id")).alias("baseline_id"))


def summary(events: DataFrame, *key: str) -> DataFrame:
    """Counts of new, resolved and ongoing issues, of new and removed pages, and of the pages that changed."""
    page = (F.col("entity_type") == "page") & ~F.col("event_type").isin("page_new", "page_removed")
    n = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    return events.groupBy(*key).agg(
        n("issue_new", "new_issues"), n("issue_resolved", "resolved_issues"), n("issue_ongoing", "ongoing_issues"), n("page_new", "new_pages"), n("page_removed", "removed_pages"),
        F.count_distinct(F.when(page, F.struct("url"))).alias("changed_pages"),
    )


def priority() -> Column:
    """Rank of an event for reports: its severity's, else 1 for the weighty kinds and 3 for others."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, r) for s, r in config.SEVERITIES.items()), F.lit(4))
    return F.when(F.coalesce("severity", F.lit("")) != "", rank).when(F.col("event_type").isin(*config.HIGH_PRIORITY_EVENTS), 1).otherwise(3)


def compare_crawls(pairs: DataFrame, issues: tuple[DataFrame, DataFrame], pages: tuple[DataFrame, DataFrame], key: str = "pair") -> tuple[DataFrame, DataFrame]:
    """(comparison, events) of crawls with the crawl before them. pairs: key, previous_id; issues and pages: (current, previous).

    Without a previous crawl a crawl is a baseline: no events, and zeros. A
    previous crawl without any row is none the less one, to which all is new.
    """
    compared = pairs.filter("previous_id is not null").select(key)
    both = [compare_issues(*(x.join(compared, key, "left_semi") for x in issues), key), compare_pages(*(x.join(compared, key, "left_semi") for x in pages), key)]
    events = both[0].unionByName(both[1])
    counts = ["new_issues", "resolved_issues", "ongoing_issues", "new_pages", "removed_pages", "changed_pages"]
    comparison = pairs.select(key, "previous_id", F.col("previous_id").isNull().alias("baseline")).join(summary(events, key), key, "left").fillna(0, counts)
    return comparison.select(key, "baseline", "previous_id", *counts), events
