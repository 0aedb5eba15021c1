"""Sorted, looked up and composed rows of the dashboard; settings."""

import datetime as dt
import json

import pytest

from sitespan import settings
from sitespan.plans import dashboard, views

T = lambda d: dt.datetime(2024, 1, d)


def issues(spark):
    rows = [("k1", "low", "https://h/b", T(2)), ("k2", "critical", "https://h/B", None), ("k3", "critical", "https://h/a", T(1)), ("k4", "odd", "https://h/c", T(3)), ("k5", None, "https://h/d", T(4))]
    return spark.createDataFrame(rows, "issue_key string, severity string, url string, first_seen_at timestamp_ntz")


def test_sorting(spark):
    d = issues(spark)
    order = lambda **k: [r.issue_key for r in dashboard.sort_issues(d, **k).collect()]
    assert order() == ["k2", "k3", "k1", "k4", "k5"]
    assert order(descending=True) == order()[::-1]  # the tie-break turns round, too
    assert order(by="url") == ["k2", "k3", "k1", "k4", "k5"] and order(by="url", descending=True) == order(by="url")[::-1]
    assert order(by="first_seen") == ["k2", "k3", "k1", "k4", "k5"]
    assert [r.issue_key for r in dashboard.worst_first(d).collect()] == ["k3", "k2", "k1", "k4", "k5"]  # as a reader sorts addresses
    assert [r.issue_key for r in dashboard.by_id(d, "k4", "issue_key").collect()] == ["k4"]


def test_sites_by_name(spark):
    d = spark.createDataFrame([(1, "b", "b.com", "https://b.com", None, 0), (2, "a", "a.com", "https://a.com", None, 0)], "id int, name string, domain string, base_url string, last_successful_crawl_at timestamp_ntz, x int")
    assert [r.id for r in dashboard.list_sites(d).collect()] == [2, 1]


def test_page_detail(spark):
    pages = spark.createDataFrame([(1, 9, "u", "t"), (1, 9, "v", "t"), (2, 8, "u", "t")], "site_id int, run_id int, url string, title string")
    found = spark.createDataFrame([(1, "u", "b", "low", "u::b"), (1, "u", "a", "high", "u::a"), (2, "u", "c", "low", "u::c")], "site_id int, url string, issue_type string, severity string, issue_key string")
    changes = spark.createDataFrame([(k, 1, "u", "issue_new", T(k + 1), 9 + k % 2) for k in range(9)], "id int, site_id int, url string, event_type string, created_at timestamp_ntz, run_id int")
    runs = spark.createDataFrame([(9, "www.h.com")], "id int, preferred_host string")
    got = {(r.site_id, r.url): r for r in dashboard.page_detail(pages, found, changes, runs, n=4).collect()}
    assert [x.issue_type for x in got[1, "u"].issues] == ["a", "b"] and [x.id for x in got[1, "u"].changes] == [8, 7, 6, 5]
    assert (got[1, "u"].preferred_host, got[2, "u"].preferred_host) == ("www.h.com", None)
    assert got[1, "v"].issues == [] and got[1, "v"].changes == [] and [x.issue_key for x in got[2, "u"].issues] == ["u::c"]
    assert {(r.site_id, r.url) for r in dashboard.page_detail(pages, found, changes, runs, url="v").collect()} == {(1, "v")}
    assert {r.id for r in dashboard.crawl_events(changes, 10).collect()} == {1, 3, 5, 7}


def test_report(spark, tmp_path):
    views.write_report(spark.createDataFrame([(1, [("a", 2)])], "run int, issues array<struct<type:string,n:int>>"), f"{tmp_path}/r")
    rows = [json.loads(x) for p in (tmp_path / "r").glob("part-*") for x in p.read_text().splitlines()]
    assert rows == [{"run": 1, "issues": [{"type": "a", "n": 2}]}]


def test_settings():
    got = settings.settings({"SITE_URL": "https://Ex.com/x", "MAX_PAGES": "7", "DISCOVER_INTERNAL_URLS": "false", "DASHBOARD_STALE_HOURS": "1.5", "DASHBOARD_ADMIN_TOKEN": ""})
    assert (got["site_host"], got["max_pages"], got["discover_links"], got["freshness_hours"], got["admin_token"]) == ("ex.com", 7, False, 1.5, None)
    assert (got["max_discovered_pages"], got["max_crawl_depth"], got["cooldown_seconds"], got["environment"]) == (100, 3, 300.0, "local")
    with pytest.raises(ValueError) as e:
        settings.settings({"MAX_PAGES": "-1", "MAX_CONCURRENCY": "0", "REQUEST_DELAY_MS": "1.5", "PERSIST_RESULTS": "yes", "DASHBOARD_ADMIN_TOKEN": "short", "DASHBOARD_ENVIRONMENT": "x", "USER_AGENT": "", "MAX_CRAWL_DEPTH": ""})
    told = str(e.value)
    assert all(n in told for n in ("SITE_URL: is required", "MAX_PAGES", "MAX_CONCURRENCY", "REQUEST_DELAY_MS", "PERSIST_RESULTS", "DASHBOARD_ADMIN_TOKEN", "DASHBOARD_ENVIRONMENT", "USER_AGENT", "MAX_CRAWL_DEPTH"))
