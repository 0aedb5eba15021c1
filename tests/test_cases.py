"""Queries over cases against their SQL twins, and what literal rows say of values, baselines, hosts and budgets."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sitespan import cases, config
from sitespan.operators import graph, history, rules, samples
from sitespan.plans import audit
from sitespan.sources import discovery

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_sql_twins(spark, duck, name):
    df = cases.QUERIES[name](spark, SF)
    want = duck.execute(cases.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, df.select(*names).collect()), key=key)
    assert got == sorted(want.fetchall(), key=key) and got


def test_every_rule_meets_cases(spark):
    kinds = {r["issue_type"] for r in rules.apply_page_rules(cases.case_pages(spark, SF), ["k"]).select("issue_type").distinct().collect()}
    assert len(kinds) >= 36 and kinds <= set(config.RECOMMENDATIONS)


def test_generic_texts_are_not_ambiguous(spark):
    a = [(f"h/{i}", "Read more!", True) for i in range(4)] + [(f"h/{i}", "our team", True) for i in range(4)] + [("o", "our team", False)]
    d = spark.createDataFrame([(1, a)], "p int, anchors array<struct<href:string,text:string,is_internal:boolean>>")
    got = samples.ambiguous_anchors(d, ["p"]).collect()
    assert [(r["text"], r["destinations"]) for r in got] == [("our team", ["h/0", "h/1", "h/2", "h/3"])]


def test_baseline_has_no_events(spark):
    page = "pair int, url_key string, url string, ord int, title string"
    issue = "pair int, issue_key string, url string, severity string, ord int"
    now = spark.createDataFrame([(1, "u", "u", 1, "a"), (2, "u", "u", 1, "a"), (3, "u", "u", 1, "a")], page)
    before = spark.createDataFrame([(2, "u", "u", 1, "b")], page)
    i = spark.createDataFrame([(1, "k", "u", "high", 1), (2, "k", "u", "high", 1), (3, "k", "u", "low", 1)], issue)
    pairs = spark.createDataFrame([(1, None), (2, 7), (3, 8)], "pair int, previous_id int")
    comparison, events = history.compare_crawls(pairs, (i, i.filter("pair = 2")), (now, before))
    got = {r["pair"]: tuple(r)[1:] for r in comparison.collect()}
    assert got == {1: (True, None, 0, 0, 0, 0, 0, 0), 2: (False, 7, 0, 0, 1, 0, 0, 1), 3: (False, 8, 1, 0, 0, 1, 0, 0)}  # a previous crawl without rows is one
    assert sorted((r["pair"], r["event_type"]) for r in events.collect()) == [(2, "field_changed"), (2, "issue_ongoing"), (3, "issue_new"), (3, "page_new")]


def test_shared_titles_list_the_others(spark):
    rows = [("r", k, f"u{k}", t, ok) for k, t, ok in [(1, "A", True), (2, " a", True), (3, "a", False), (4, "b", True)]]
    d = spark.createDataFrame(rows, "run string, ord int, url string, title string, is_indexable boolean")
    assert {r["url"]: r["other_urls"] for r in graph.duplicates(d, "title", collect_others=True).collect()} == {"u1": ["u2"], "u2": ["u1"]}
    classes = graph.duplicate_classes(d, "title").collect()
    assert [(r["value"], r["n"], r["first_url"]) for r in classes] == [("a", 2, "u1")]
    members = graph.duplicate_members(d, "title")
    assert {(r["class_id"], r["ord"]) for r in members.collect()} == {(classes[0]["class_id"], 1), (classes[0]["class_id"], 2)}
    assert [r["url"] for r in graph.other_pages(members, classes[0]["class_id"]).collect()] == ["u1", "u2"]
    assert [r["url"] for r in graph.other_pages(members, classes[0]["class_id"], url="u1").collect()] == ["u2"]
    assert [r["url"] for r in graph.other_pages(members, classes[0]["class_id"], after=1).collect()] == ["u2"]
    assert graph.other_pages(members, classes[0]["class_id"], size=1).count() == 1


def test_issues_grow_with_the_pages_of_a_class(spark):
    """A title that all pages share gives each of them an issue of the same size."""
    def size(n):
        d = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("ord"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("same").alias("title"), F.lit(True).alias("is_indexable"))
        return graph.duplicates(d, "title").select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]

    assert size(4000) < 4.5 * size(1000)


def test_host_issue_goes_to_the_homepage(spark):
    fetches = [("r", k, f"https://h.com{p}", f"https://h.com{p}", "h.com", 200, "ok", 0, "<!doctype html><title>One title for all the pages</title><p>x", {}, True, False) for k, p in ((1, "/a"), (2, "/"), (3, "/b"))]
    d = spark.createDataFrame(fetches, "run string, ord int, url string, final_url string, site_host string, status int, outcome string, redirect_count int, html string, headers map<string,string>, in_sitemap boolean, discovered boolean")
    probes = spark.createDataFrame([("r", "https://h.com", "h.com", "www.h.com", 200, None)], "run string, site_url string, preferred_host string, alternate_host string, status int, location_host string")
    sitemap = spark.createDataFrame([("r", "https://h.com/a")], "run string, key string")
    pages, issues, scores = audit.audit(d, sitemap, F.current_timestamp(), probes, others=True)
    rows = issues.collect()
    assert [r["url"] for r in rows if r["issue_type"] == "host_canonicalization_issue"] == ["https://h.com/"]
    shared = [r for r in rows if r["issue_type"] == "duplicate_title"]
    assert len(shared) == 3 and shared[0]["message"] == 'Title "One title for all the pages" is shared by 3 indexable pages.' and "otherUrls" in shared[0]["value"]
    assert all(r["recommendation"] for r in rows) and scores.count() == 1


def test_budget_fills_in_first_seen_order(spark):
    edges = spark.createDataFrame([(0, 9, 1), (0, 2, 2), (9, 5, 1), (9, 3, 2), (2, 1, 1)], "src long, dst long, pos int")
    got = {r["node"]: r["depth"] for r in discovery.bfs(edges, spark.createDataFrame([(0,)], "node long"), 3, 4).collect()}
    assert got == {0: 0, 9: 1, 2: 1, 5: 2, 3: 2}
    starts = spark.createDataFrame([(k,) for k in range(5)], "node long")  # starts are no part of the budget
    star = spark.createDataFrame([(k, 10 + k, 0) for k in range(5)], "src long, dst long, pos int")
    assert {r["node"] for r in discovery.bfs(star, starts, 2, 3).collect()} == {0, 1, 2, 3, 4, 10, 11, 12}
    pages = spark.createDataFrame([(r, k) for r in (1, 2) for k in range(9)], "run int, ord int")
    assert discovery.most_pages(pages, 0).count() == 18
    assert {tuple(r) for r in discovery.most_pages(pages, 4).collect()} == {(r, k) for r in (1, 2) for k in range(4)}


def test_sitemaps_of_any_depth_and_with_comments(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    deep = [(f"https://h.com/s{k}.xml", f"<sitemapindex {ns}><sitemap><loc>https://h.com/s{k + 1}.xml</loc></sitemap></sitemapindex> <!-- end -->") for k in range(25)]
    files = spark.createDataFrame([*deep, ("https://h.com/s25.xml", f"<urlset {ns}><url><loc>https://h.com/page</loc></url></urlset>\n<!-- made\nby hand -->\n")], "url string, xml string")
    got = discovery.sitemap_urls(files, spark.createDataFrame([("h.com", "https://h.com/s0.xml")], "site string, url string"))
    assert [r["url"] for r in got.collect()] == ["https://h.com/page"]
