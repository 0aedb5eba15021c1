"""Results that only larger tables showed to differ, and steps whose memory or time grew faster than their input."""

import json
import re
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitespan import cases, queries
from sitespan.functions import html
from sitespan.operators import graph, rules
from sitespan.sources import adapters


@pytest.fixture
def table_of(spark, tmp_path):
    """Writes rows as a table of a data folder; gives the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def twin(name, sf_dir, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    return sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())


def test_headings_that_break_off_within_a_reference(spark, table_of):
    titles = ["a &amp;&amp", "a &amp;", "x &lt;b&gt; &quot;q&#39;", "&amp;lt;", "&ampx;", "&lt", "&notit;"]
    d = table_of("pages", [(k, f"https://h.com/{k}", f"<html><body><h1>{t}</h1></body></html>") for k, t in enumerate(titles)], "page_id long, url string, html string")
    got = sorted(map(tuple, queries.html_headings(spark, d).collect()))
    assert got == twin("html_headings", d, "pages") and len(got) == len(titles)
    assert html.raw_facts("<h1>a &amp;&amp</h1>", "https://h.com/")["h1"] == ["a &&"]  # the parser itself keeps to the standard


def test_facts_of_a_batch_come_in_parts(spark):
    rows = [None, "x" * (html.PART_BYTES + 1), "", *["y" * (html.PART_BYTES // 3)] * 7, *["z"] * 1000]
    parts = list(html.parts_of(pa.array(rows)))
    assert [at for at, _ in parts] == [0, *(sum(n for _, n in parts[: k + 1]) for k in range(len(parts) - 1))] and sum(n for _, n in parts) == len(rows)
    assert all(n <= html.PART_PAGES and (n == 1 or sum(len(r or "") for r in rows[at : at + n]) <= html.PART_BYTES) for at, n in parts)
    assert list(html.parts_of(pa.array([], pa.string()))) == []
    d = spark.range(1000, numPartitions=1).selectExpr("id", "if(id % 7 = 0, null, concat('<title>t', id, '</title><a href=\"/', id, '\">x</a>')) as html", "'https://h.com/' as final_url")
    got = html.with_facts(d).select("id", "title", "internal_links").collect()
    assert sorted(map(tuple, got)) == [(k, f"t{k}" if k % 7 else None, [f"https://h.com/{k}"] if k % 7 else []) for k in range(1000)]


def test_others_of_a_class_are_counted_without_lists(spark, table_of):
    row = "run int, ord long, url string, title string, is_indexable boolean"
    titles = ["A", "a ", "a", "A", "b", "B", "c", None, "", "A"]
    d = spark.createDataFrame([(k % 2 if t == "b" else 0, k, f"u{k // 2 if k < 4 else k}", t, k != 9) for k, t in enumerate(titles)], row)
    lists = {r["ord"]: len(r["other_urls"]) for r in graph.duplicates(d, "title", collect_others=True).collect()}
    counts = {r["ord"]: r["n_others"] for r in graph.with_others_counted(graph.duplicates(d, "title")).collect()}
    assert counts == lists and set(counts.values()) >= {1, 2}
    parts = table_of("part", [(k, "Same title" if k % 2 else f"t{k // 20}", "TYPE A", k % 48) for k in range(2000)], "p_partkey long, p_name string, p_type string, p_size int")
    q = queries.duplicate_titles(spark, parts)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{parts}/part.parquet/*.parquet'")
    con.execute("create view lineitem as select 0 as l_orderkey, 0 as l_partkey, 1 as l_linenumber")
    assert sorted(map(tuple, q.collect())) == sorted(con.execute(queries.ORACLE_SQL["duplicate_titles"]).fetchall())
    assert "collect_list" not in q._jdf.queryExecution().toString()


def test_short_rows_of_one_file_are_dealt_out(spark, table_of):
    parts = table_of("part", [(k,) for k in range(30_001)], "p_partkey long")
    customers = table_of("customer", [(k,) for k in range(12_000)], "c_custkey long")
    for d, rows in ((cases.case_pages(spark, parts), 30_001), (cases.rules_ambiguous_anchors(spark, parts), None), (cases.markup_facts(spark, customers), 12_000)):
        n = [r["count"] for r in d.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(n) == 4 and max(n) < 1.2 * sum(n) / 4 and (rows is None or sum(n) == rows)
    big = adapters.spread(spark.range(100_000, numPartitions=1), "id")
    assert big.rdd.getNumPartitions() == 10 and big.count() == 100_000
    assert adapters.spread(spark.range(0), "id").count() == 0


def test_repeated_headings_of_long_pages(spark):
    pages = [[(1, "B"), (2, "a"), (3, " A "), (1, "b"), (2, None), (2, None), (4, "a"), (1, ""), (1, " "), (5, "c"), (5, "d"), (6, "D")], [], [(1, "x")] * 4, [(k % 6 + 1, f"h {k // 3 if k % 5 else k}") for k in range(3000)]]
    d = spark.createDataFrame(list(enumerate(pages)), "k int, headings array<struct<level:int,text:string>>").withColumn("word_count", F.lit(0))
    began = time.time()
    got = d.select("k", F.inline(rules.heading_issues())).filter("issue_type = 'duplicate_heading_text'").collect()
    assert time.time() - began < 10  # texts are compared once they are sorted, not each with each
    want = []
    for k, page in enumerate(pages):
        groups = {}
        for level, t in page:
            if t is not None and (norm := re.sub(r"\s+", " ", t).strip().lower()):
                groups.setdefault(norm, []).append((level, t))
        want += [(k, "medium" if len(g) > 2 else "low", f'Heading text "{g[0][1]}" is repeated {len(g)} times on the page.', {"text": t, "occurrences": len(g), "levels": [x for x, _ in g]}) for t, g in groups.items() if 2 <= len(g) <= 3]
    assert [(r["k"], r["severity"], r["message"], json.loads(r["value"])) for r in got] == want and len(want) > 500


def test_backfill_reads_markup_once(spark, monkeypatch):
    read, plain = [], adapters.table
    monkeypatch.setattr(adapters, "table", lambda spark, d, name: read.append(name) or plain(spark, d, name))
    queries.score_backfill(spark, "/root/testdata/sf0.001")
    assert read == ["pages"]


def test_latest_crawl_counts_issues_and_pages_in_one_aggregate(spark):
    plan = cases.latest_crawl(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join LeftOuter") == 3  # one each for counts, changes and scores


def test_words_of_markup_are_counted_in_one_reading(spark):
    wide = [chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    white = [*"\t\n\x0b\f\r ", *wide]
    texts = [None, "", " ", "a", *(f"{w}a{w}b{w}{w} c" for w in white), *(f"{w}{v}" for w in white for v in wide[:2]), "é ü​\u0085᠎ x", "\U0001f600 \U0001f600\U0001f600", "a\x1cb \x00", "x " * 5000]
    pages = [*texts, "<HEAD >a b</head>c<b>d</b> e<!-- f -->", "a<script src>x y</script>b <style>p q</STYLE>c", "<<script >x</script>b>c d", "a < b > c", "<head>a b", "a<br>b"]
    d = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    q = d.select("k", adapters.flat_words("html").alias("n"))

    def words(page):
        body = re.sub(r"(?is)<head[ >].*?</head>|<script[ >].*?</script>|<style[ >].*?</style>", "", page or "")
        return len([w for w in re.split("[" + "".join(white) + "]+", re.sub(r"<[^>]*>", "", body)) if w])

    assert {r["k"]: r["n"] for r in q.collect()} == {k: words(p) for k, p in enumerate(pages)}
    assert q._jdf.queryExecution().optimizedPlan().toString().count("</head>") == 1  # the markup goes through it once


def test_backfill_deals_pages_of_one_file_out(spark, table_of, monkeypatch):
    page = lambda k: f'<!doctype html><html lang="en"><head><title>Title {k % 7}</title></head><body><h1>x</h1>{"<p>some words</p> " * (k % 5)}</body></html>'
    d = table_of("pages", [(k, f"https://h{k % 6}.com/{k}", page(k) if k % 11 else None) for k in range(6000)], "page_id long, url string, html string")
    made, plain = [], queries.cut

    def cut(df, tag="step"):
        made.append((tag, plain(df, tag)))
        return made[-1][1]

    monkeypatch.setattr(queries, "cut", cut)
    got = sorted(map(tuple, queries.score_backfill(spark, d).collect()))
    assert got == twin("score_backfill", d, "pages") and len(got) == 6
    n = [r["count"] for r in dict(made)["facts"].groupBy(F.input_file_name()).count().collect()]
    assert len(n) == 4 and sum(n) == 6000 and max(n) < 1.2 * sum(n) / 4


def test_links_after_odd_markup_are_counted(spark, table_of):
    odd = ["", "1 <é 2 ", "<ü>", "<svg><style/></svg>", "<title>a <!-- b</title>", "<textarea><!-- </textarea>", "a </ b>"]
    pages = [(k, f"https://h.com/{k}", f'<html><body><a href="/a">a</a>{x}<a href="/b">b</a><a href="/c/{k}">c</a></body></html>') for k, x in enumerate(odd)]
    d = table_of("pages", [*pages, (90, "https://h.com/90", None), (91, "https://h.com/91", "<p>none</p>")], "page_id long, url string, html string")
    got = sorted(map(tuple, queries.html_links_internal_external(spark, d).collect()))
    assert got == twin("html_links_internal_external", d, "pages") == [(k, 3) for k in range(len(odd))]
