"""Snapshots written once and again, read back and scored anew."""

import datetime as dt

from pyspark.sql import functions as F

from sitespan import lineage
from sitespan.operators import history, scoring
from sitespan.plans import audit, snapshots

FETCH = "run int, ord int, url string, final_url string, site_host string, status int, outcome string, redirect_count int, html string, headers map<string,string>, in_sitemap boolean, discovered boolean"
PAGE = '<!doctype html><html lang="en"><head><title>A title of its own, page {k}</title><meta name=viewport content=x></head><body><h1>H</h1><a href="/gone">the gone page</a><a href="/p{k}">next page</a><img src=x></body></html>'


def fetched(spark):
    rows = []
    for run in (1, 2, 3):
        rows.append((run, 0, "https://h.com/", "https://h.com/", "h.com", 200, "ok", 0, PAGE.format(k=run), {"content-encoding": "br"}, True, False))
        rows.append((run, 1, "https://h.com/gone", "https://h.com/gone", "h.com", 404, "http_error", 0, None, {}, True, False))
        rows += [(run, 2 + k, f"https://h.com/p{k}", f"https://h.com/p{k}", "h.com", None if run == 3 and k == 1 else 200, "network_error" if run == 3 and k == 1 else "ok", 0, PAGE.format(k=k % run), {}, k % 2 == 0, False) for k in range(3 * run)]
    return spark.createDataFrame(rows, FETCH)


def test_scores_rebuilt_from_snapshots(spark, tmp_path):
    runs = spark.createDataFrame([(k, 7, "success", dt.datetime(2024, 1, k)) for k in (1, 2, 3, 4)] + [(5, 7, "running", dt.datetime(2024, 1, 5))], "id int, site_id int, status string, started_at timestamp_ntz")
    f = fetched(spark)
    sitemap = f.filter("in_sitemap").select("run", F.col("url").alias("key"))
    pages, issues, scores = audit.audit(f, sitemap, F.lit(dt.datetime(2024, 2, 1)))
    p = snapshots.page_rows(pages, runs)
    i = snapshots.issue_rows(issues.withColumn("ord", F.col("page_ord") * 10_000 + F.col("ord")), p)
    for _ in range(2):  # a job that is started again
        snapshots.write_runs(p, f"{tmp_path}/pages", runs)
        snapshots.write_runs(i, f"{tmp_path}/issues", runs)
    p2, i2 = snapshots.stored_rows(spark, f"{tmp_path}/pages", p), snapshots.stored_rows(spark, f"{tmp_path}/issues", i)
    assert p2.count() == pages.count() and i2.count() == issues.count() and p2.select("id").distinct().count() == p2.count()
    assert {r.status_code for r in p2.filter("crawl_run_id = 3").collect()} == {200, 404, None}
    assert p2.filter("internal_outbound_link_count = 2 and image_count = 1 and title_length > 0").count() > 5
    none = spark.createDataFrame([], "crawl_run_id int, overall_score int")
    first = {r.run: (r.overall_score, round(r.raw, 9), r.cap_applied) for r in scores.collect()}
    got = {r.crawl_run_id: r for r in snapshots.backfilled(runs, p2, i2, none).collect()}
    assert {k: (r.overall_score, round(r.overall_score_raw, 9), r.safety_cap_applied) for k, r in got.items() if k != 4} == first
    assert len({x[1] for x in first.values()}) == 3
    empty = scoring.empty_score(spark).first()
    assert (got[4].overall_score, got[4].safety_cap_applied) == (empty["overall_score"], "site_uncrawlable") and set(got) == {1, 2, 3, 4}
    assert [got[k].score_delta for k in (1, 2, 3, 4)] == [None, *(got[k].overall_score - got[k - 1].overall_score for k in (2, 3, 4))]
    # with stored scores only the others are made, and changes are from the stored ones
    have = spark.createDataFrame([(1, 3), (3, 50)], "crawl_run_id int, overall_score int")
    some = {r.crawl_run_id: r.score_delta for r in snapshots.backfilled(runs, p2, i2, have).collect()}
    assert some == {2: got[2].overall_score - 3, 4: got[4].overall_score - 50}
    forced = {r.crawl_run_id: r.score_delta for r in snapshots.backfilled(runs, p2, i2, have, force=True).collect()}
    assert forced == {k: r.score_delta for k, r in got.items()}
    lineage.clear(spark)


def test_a_write_replaces_its_runs_only(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "crawl_run_id int, v string")
    path = str(tmp_path / "t")
    snapshots.write_runs(rows((1, "a"), (1, "b"), (2, "c"), (3, "d")), path)
    about = spark.createDataFrame([(1,), (3,)], "id int")
    snapshots.write_runs(rows((1, "x")), path, about)  # run 3 has no rows any more
    got = snapshots.stored_rows(spark, path, rows((0, ""))).collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, "c")]


def test_changes_have_the_same_id_again(spark):
    now = spark.createDataFrame([(1, "u::a", "u", "high", 1), (1, "u::b", "u", "low", 2)], "pair int, issue_key string, url string, severity string, ord int")
    before = spark.createDataFrame([(1, "u::a", "u", "low", 1), (1, "u::c", "u", "low", 1)], now.schema)
    runs = spark.createDataFrame([(1, 7)], "id int, site_id int")
    made = [snapshots.change_rows(history.compare_issues(now, before), runs, F.lit("t")).orderBy("id").collect() for _ in range(2)]
    assert made[0] == made[1] and len({r.id for r in made[0]}) == 4 and {r.site_id for r in made[0]} == {7}
