"""Comparison by digests against the comparison of whole rows, with structured types, nulls and repeated keys."""

import random

import pytest

from sitespan.operators import history

COLS = "pair int, url_key string, url string, ord int, status int, title string, word_count int, noindex boolean, in_sitemap boolean, final_url string, structured_types array<string>"


def crawl(rng, n):
    return [(rng.choice([1, 2]), f"k{rng.randint(0, n)}", f"u{k}", k, rng.choice([200, 200, 404, None]), rng.choice(["T", " T ", "t", None, ""]), rng.choice([100, 120, 300, None]), rng.choice([True, False]), rng.choice([True, False]),
             rng.choice(["https://h.com/a/", "https://h.com/a", None]), rng.choice([["A", "B"], ["B", "A"], ["A", "A", "B"], ["A"], [], None])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_events_as_the_comparison_of_whole_rows(spark, seed):
    rng = random.Random(seed)
    a = crawl(rng, 60)
    b = [r if rng.random() < 0.6 else crawl(rng, 60)[rng.randrange(60)] for r in a]
    current, previous = spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS)
    want = sorted(map(str, history.compare_pages(current, previous).collect()))
    assert sorted(map(str, history.compare_changed_pages(current, previous).collect())) == want and len(want) > 20
    fields = history.compared_fields(current, previous)
    held = (history.page_digests(current, fields), history.page_digests(previous, fields))
    assert sorted(map(str, history.compare_changed_pages(current, previous, digests=held).collect())) == want
    kinds = {r.field_name for r in history.compare_changed_pages(current, previous).collect()}
    assert {"structured_data", "title", "word_count", "final_url", "status_code"} <= kinds


def test_unchanged_pages_are_left_out(spark):
    rows = [(1, f"k{k}", f"u{k}", k, 200, "T", 100, False, True, "f", ["A"]) for k in range(50)]
    changed = [r if r[3] != 7 else (*r[:4], 500, *r[5:]) for r in rows]
    a, b = spark.createDataFrame(changed, COLS), spark.createDataFrame(rows, COLS)
    fields = history.compared_fields(a, b)
    assert [r.url_key for r in history.unlike(history.page_digests(a, fields), history.page_digests(b, fields)).collect()] == ["k7"]
    assert [(r.url, r.event_type) for r in history.compare_changed_pages(a, b).collect()] == [("u7", "http_status_changed")]


def test_structured_types_in_any_order_are_equal(spark):
    one = lambda t: spark.createDataFrame([(1, "k", "u", 1, 200, "T", 1, False, True, "f", t)], COLS)
    for before, after, changes in ([["A", "B"], ["B", "A", "A"], 0], [["A"], ["B"], 1], [None, [], 0], [None, ["A"], 1]):
        assert history.compare_changed_pages(one(after), one(before)).count() == changes
