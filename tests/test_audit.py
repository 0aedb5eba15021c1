"""The audit on literal rows: what each operator is expected to say."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitespan import config
from sitespan.functions import html, text, urls
from sitespan.operators import graph, history, rules, samples, scoring
from sitespan.plans import audit, dashboard, views
from sitespan.sources import discovery
from sitespan.streaming import control


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols[c] for c in names)], ", ".join(f"{c} string" for c in names)).select(expr.alias("x")).first()["x"]


NORMALIZED = [
    ("https://Ex.com/page#x", "https://ex.com/page"), ("https://ex.com/page/", "https://ex.com/page"), ("https://ex.com/", "https://ex.com/"), ("https://ex.com", "https://ex.com/"),
    ("https://EX.com/Path", "https://ex.com/Path"), ("https://ex.com:443/a", "https://ex.com/a"), ("http://ex.com:80/a", "http://ex.com/a"), ("http://ex.com:8080/a", "http://ex.com:8080/a"),
    ("https://ex.com/?utm_source=a&q=foo&UTM_medium=b", "https://ex.com/?q=foo"), ("https://ex.com/?b=2&a=1&a=0", "https://ex.com/?a=1&a=0&b=2"), ("https://ex.com/?a&ref=z", "https://ex.com/?a="),
    ("https://ex.com/?a=b%20c", "https://ex.com/?a=b+c"), ("not a url", None), ("", None), (None, None), ("mailto:a@b", None),
]


def test_normalize(spark):
    d = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(NORMALIZED)], "k int, u string")
    got = [r["x"] for r in d.select("k", urls.normalize("u").alias("x")).orderBy("k").collect()]
    assert got == [want for _, want in NORMALIZED]
    assert [urls.resolve(raw) for raw, _ in NORMALIZED if raw is not None] == [want for raw, want in NORMALIZED if raw is not None]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("/a/b/../c", "https://h.com/a/c"), ("x?q=1", "https://h.com/dir/x?q=1"), ("#top", "https://h.com/dir/page?z=1"), ("//o.com/p", "https://o.com/p"), ("?n=2", "https://h.com/dir/page?n=2"), ("", "https://h.com/dir/page?z=1"),
     ("a b", "https://h.com/dir/a%20b"), ("./", "https://h.com/dir"), ("https:rel", "https://h.com/dir/rel"), ("javascript:x", None), ("http://[::1]:80/x", "http://[::1]/x"), ("\\a", "https://h.com/a")],
)
def test_resolve_relative(raw, want):
    assert urls.resolve(raw, "https://h.com/dir/page?z=1") == want


def test_url_predicates(spark):
    d = spark.createDataFrame([("https://www.a.com/x.PDF?x=1&y=2&z=3",), ("https://a.com/episodes/one",), ("https://a.com/",), ("bad",)], "u string")
    got = d.select(urls.is_asset("u").alias("a"), urls.is_crawlable("u").alias("c"), urls.page_type("u").alias("t"), urls.safe_pathname("u").alias("p"), urls.is_same_domain("u", F.lit("A.com")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, False, "generic", "/x.PDF", False), (False, True, "episode", "/episodes/one", True), (False, True, "homepage", "/", True), (False, False, "unknown", "", False)]
    assert one(spark, urls.display_path("u", F.lit("https://a.com")), u="https://a.com") == "/"
    assert one(spark, urls.alternate_host("u"), u="www.a.com") == "a.com" and one(spark, urls.alternate_host("u"), u="a.com") == "www.a.com"
    assert one(spark, urls.issue_key("u", F.lit("t")), u="https://a.com/x/") == "https://a.com/x::t"


def plain_width(s):
    w = {c: v for v, cs in config.GLYPHS for c in cs}
    total = sum(w.get(c, 9 if c.isascii() and c.isdigit() else 10.5 if "A" <= c <= "Z" else 8 if "a" <= c <= "z" else 9) for c in s)
    return int(total + 0.5)


def test_pixel_width(spark):
    shown = ["", "i" * 62, "W" * 62, "Hello, World! [x] \\ / - 'q' 100% é 日本 “a” ’"]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(shown)], "k int, s string").orderBy("k")
    got = d.select(text.pixel_width("s").alias("w"), text.utf16_length(F.concat("s", F.lit("𝒳"))).alias("n")).collect()
    assert [tuple(r) for r in got] == [(plain_width(s), len(s) + 2) for s in shown]


PAGE = """<!doctype html><html lang=" en "><head><title> A  title </title><meta NAME="Description" content=" d "><meta property="og:title" content="og"><meta name="twitter:card" content="c">
<link rel="canonical" href="/c/?utm_source=x"><link rel="shortcut icon" href="/f.ico"><meta name="viewport" content="w"><meta http-equiv="content-type" content="text/html; charset = utf-8 ;x"><meta name=robots content="NOINDEX">
<link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="" href=""><link rel="stylesheet" href="http://x.com/a.css">
<script type="application/ld+json">{"@graph":[{"@type":["PodcastEpisode","Thing"],"datePublished":"2020-01-01T00:00:00Z","episodeNumber":7},{"@type":"Person"}]}</script><script type="application/ld+json">{bad</script>
<script>var t="</p><h1>no</h1>";</script></head><body><nav><p>navigation text that is long enough to count as a repeated block</p></nav>
<h1>One</h1><h2> </h2><h3>T  wo</h3><p>a</p><p>b<b>c<br><p>d <a href="#x">frag</a><a href=" /in/ "> </a><a href="/in" aria-label="label">i</a><a href="https://out.org"><img src="http://x.com/i.png" alt="pic ture"></a><a href="MAILTO:z">m</a>
<a href="/one">Click here!</a><img src="/a.png"><img alt=" "></body></html>"""


def test_html_facts():
    f = html.raw_facts(PAGE, "https://h.com/p")
    assert (f["title"], f["meta_description"], f["canonical"], f["lang"], f["charset"], f["robots"]) == ("A  title", "d", "https://h.com/c", "en", "utf-8", "NOINDEX")
    assert f["has_viewport"] and f["has_favicon"] and f["has_doctype"]
    assert f["headings"] == [{"level": 1, "text": "One"}, {"level": 3, "text": "T wo"}] and f["h1"] == ["One"]
    assert f["internal_links"] == ["https://h.com/p", "https://h.com/in", "https://h.com/one"] and f["external_links"] == ["https://out.org/"]
    assert [(a["text"], a["is_internal"]) for a in f["anchors"]] == [("", True), ("label", True), ("pic ture", False), ("Click here!", True)]
    assert (f["images_total"], f["images_missing_alt"]) == (3, 2)
    assert f["mixed_content"] == ["http://x.com/a.css", "http://x.com/i.png"]
    assert f["structured_types"] == ["PodcastEpisode", "Thing", "Person"]
    assert f["episodes"][0]["date_published"] == "2020-01-01T00:00:00Z" and f["episodes"][0]["episode_number"] == "7"
    assert f["alternate_links"] == [{"hreflang": "de", "href": "/de"}]
    assert f["open_graph"]["title"] == "og" and f["twitter"]["card"] == "c"
    assert f["blocks"][:3] == ["one", "t wo", "a"] and not any("navigation" in b for b in f["blocks"])
    assert "".join(f["body_text"].split()).startswith("navigation") and "no" not in f["h1"]


def test_words_join_without_separator(spark):
    d = spark.createDataFrame([("<p>a</p><p>b</p> c<script>x y</script>", "https://h.com/")], "html string, final_url string")
    assert html.with_facts(d).first()["word_count"] == 2


def test_publication_state(spark):
    t = "array<struct<type:string,date_published:string>>"
    d = spark.createDataFrame([([("PodcastEpisode", "2020-01-01T00:00:00Z")],), ([("PodcastEpisode", "2999-01-01")],), ([("PodcastEpisode", "soon")],), ([],)], f"e {t}")
    assert [r[0] for r in d.select(html.publication_state("e", F.lit(dt.datetime(2024, 1, 1)))).collect()] == ["published", "scheduled", "unknown", "unknown"]


CLEAN = dict(url="https://h.com/", title="A good and long enough title", title_length=28, title_px=200, canonical="https://h.com/", site_host="H.com", meta_description="m", meta_description_px=100, h1_count=1, lang="en", has_favicon=True, word_count=500, page_type="homepage", charset="utf-8", has_doctype=True, compression="gzip", html_size_bytes=9000)
NESTED = {"open_graph": "struct<title:string,description:string,image:string>", "twitter": "struct<card:string,title:string,description:string,image:string>", "headings": "array<struct<level:int,text:string>>", "alternate_links": "array<struct<hreflang:string,href:string>>", "structured_types": "array<string>", "broken_internal_links": "array<string>", "ambiguous": "array<struct<text:string,n:int,destinations:array<string>>>"}
REST = {**dict.fromkeys(NESTED, []), "open_graph": ("t", None, None), "twitter": ("c", None, None, None), "outcome": "ok", "status": 200, "redirect_count": 0, "in_sitemap": False, "noindex": False, "images_missing_alt": 0, "images_total": 0, "anchor_empty": 0, "anchor_generic": 0, "repeated_blocks": 0, "mixed_content_count": 0, "x_powered_by": None, "error_message": None}
TYPES = {str: "string", int: "int", bool: "boolean", type(None): "string"}
RULES = [
    ({}, []), ({"outcome": "network_error"}, [("crawl_failure", "critical")]), ({"status": 503}, [("server_error", "critical")]), ({"status": 404, "title": None}, [("client_error", "high")]),
    ({"redirect_count": 1, "in_sitemap": True}, [("sitemap_url_redirect", "high")]), ({"noindex": True, "in_sitemap": True}, [("sitemap_url_noindex", "high")]), ({"title": None}, [("missing_title", "high")]),
    ({"title_px": 601}, [("title_pixel_width_high", "low")]), ({"title_length": 19}, [("title_too_short", "medium")]), ({"title_length": 19, "page_type": "service"}, [("title_too_short", "low")]),
    ({"canonical": "https://o.com/"}, [("canonical_external_domain", "high")]), ({"canonical": "nope"}, [("canonical_external_domain", "high")]), ({"canonical": None}, [("missing_canonical", "high")]),
    ({"meta_description": ""}, [("missing_meta_description", "medium")]), ({"meta_description_px": 951}, [("meta_description_pixel_width_high", "low")]), ({"h1_count": 0}, [("missing_h1", "medium")]), ({"h1_count": 2}, [("multiple_h1", "medium")]),
    ({"broken_internal_links": ["x"]}, [("broken_internal_links", "medium")]), ({"images_missing_alt": 1, "images_total": 2}, [("images_missing_alt", "low")]), ({"open_graph": None}, [("missing_open_graph", "low")]), ({"twitter": (None, "", None, None)}, [("missing_twitter", "low")]),
    ({"lang": ""}, [("missing_lang", "low")]), ({"has_favicon": False}, [("missing_favicon", "low")]), ({"word_count": 1}, []), ({"word_count": 149, "page_type": "generic"}, [("low_word_count", "low")]),
    ({"page_type": "episode", "word_count": 75}, [("missing_podcast_episode_schema", "medium")]), ({"page_type": "episode", "structured_types": ["PodcastEpisode"]}, []),
    ({"headings": [(1, "A"), (2, "a "), (3, "A"), (3, "b")]}, [("duplicate_heading_text", "medium")]), ({"headings": [(1, "A")] * 4}, []), ({"headings": [(1, "a"), (3, "b"), (2, "c"), (6, "d")]}, [("heading_hierarchy_skip", "low")] * 2),
    ({"headings": [(1, f"h{i}") for i in range(8)], "word_count": 60}, [("excessive_headings", "low")]), ({"headings": [(1, f"h{i}") for i in range(8)], "word_count": 29}, []),
    ({"anchor_empty": 1, "anchor_generic": 2}, [("empty_internal_anchor", "medium"), ("generic_anchor_text", "low")]), ({"ambiguous": [("a", 3, ["x", "y", "z"]), ("b", 4, [])]}, [("ambiguous_repeated_anchor_text", "low")] * 2),
    ({"repeated_blocks": 2}, [("duplicate_visible_content", "low")]), ({"repeated_blocks": 3}, [("duplicate_visible_content", "medium")]), ({"charset": None}, [("missing_charset", "low")]), ({"has_doctype": False}, [("missing_doctype", "low")]),
    ({"mixed_content_count": 1}, [("mixed_content", "high")]), ({"compression": None}, [("html_response_uncompressed", "low")]), ({"compression": "identity", "html_size_bytes": 5119}, []), ({"x_powered_by": "p"}, [("x_powered_by_exposed", "low")]),
    ({"alternate_links": [("en", ""), ("e!", "x"), ("De", "a"), ("de", "b"), ("x-default", "c")]}, [("hreflang_missing_href", "medium"), ("invalid_hreflang", "low"), ("hreflang_duplicate_language", "medium")]),
]


def test_page_rules(spark):
    base = {**CLEAN, **REST}
    schema = "k int, " + ", ".join(f"{c} {NESTED.get(c) or TYPES[type(v)]}" for c, v in base.items())
    d = spark.createDataFrame([(k, *{**base, **change}.values()) for k, (change, _) in enumerate(RULES)], schema)
    got = {}
    for r in rules.apply_page_rules(d, ["k"]).orderBy("k", "rule_ord").collect():
        got.setdefault(r["k"], []).append((r["issue_type"], r["severity"]))
    for k, (change, want) in enumerate(RULES):
        assert got.get(k, []) == want, change
    few = rules.apply_page_rules(spark.createDataFrame([("https://h.com/", 500)], "url string, status int"), ["url"]).collect()
    assert [r["issue_type"] for r in few] == ["server_error"]  # columns that are not there have the value of a page without the feature


def test_all_issue_types_are_rated():
    assert sum(map(len, config.CATEGORY.values())) == 44 and abs(sum(config.WEIGHTS.values()) - 1) < 1e-9


def test_anchor_metrics(spark):
    a = [("h/1", "Read more.", True), ("h/2", "read more", True), ("h/3", "read more", True), ("h/1", "", True), ("o", "x y", False)]
    d = spark.createDataFrame([(1, a), (2, [("h/1", "same", True)] * 3)], "p int, anchors array<struct<href:string,text:string,is_internal:boolean>>")
    m = d.select(samples.anchor_counts("anchors").alias("m")).first()["m"]
    assert (m["internal"], m["external"], m["unique_internal"], m["empty_internal"], m["generic"]) == (4, 1, 3, 1, 3)
    assert [(r["p"], r["text"], r["destinations"]) for r in samples.ambiguous_anchors(d.filter("p = 2 or p = 1"), ["p"]).collect()] == []


def graph_tables(spark):
    rows = [(1, 1, "home", "home", 200), (1, 2, "a", "a", 404), (1, 3, "b", "b2", 200), (1, 4, "b", "b", 500)]
    pages = spark.createDataFrame(rows, "run int, ord int, url_key string, final_key string, status int")
    links = spark.createDataFrame([(1, 1, "a", 0, "a"), (1, 1, "b", 1, "b"), (1, 1, "home", 2, "home"), (1, 2, "b", 0, "b"), (1, 2, "b", 1, "b")], "run int, src_ord int, key string, pos int, link string")
    return pages, links


def test_graph(spark):
    pages, links = graph_tables(spark)
    assert {(r["src_ord"], r["key"]) for r in graph.broken_links(pages, links).collect()} == {(1, "a"), (1, "b"), (2, "b")}
    assert {r["ord"]: r["inbound"] for r in graph.inbound_counts(pages, links).collect()} == {1: 0, 2: 1, 3: 0, 4: 2}
    assert {r["ord"]: r["linked"] for r in graph.page_sources(pages, links).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r["src_ord"]: r["broken_internal_links"] for r in graph.broken_by_page(pages, links).collect()} == {1: ["a", "b"], 2: ["b", "b"]}


def test_duplicates_leave_out_equal_urls(spark):
    d = spark.createDataFrame([(1, 1, "u", " T ", True), (1, 2, "u", "t", True), (1, 3, "v", "t", True), (1, 4, "w", "t", False), (1, 5, "x", "", True)], "run int, ord int, url string, title string, is_indexable boolean")
    got = {r["ord"]: (r["n"], r["other_urls"]) for r in graph.duplicates(d, "title", collect_others=True).collect()}
    assert got == {1: (3, ["v"]), 2: (3, ["v"]), 3: (3, ["u", "u"])}


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (history.words_changed, [(600, 620, False), (600, 750, True), (50, 70, True), (0, 50, False), (0, 100, True)]), (history.inbound_changed, [(10, 11, False), (3, 0, True), (0, 2, True), (10, 20, True)]),
        (history.links_changed, [(20, 23, False), (20, 31, True), (5, 8, True), (0, 1, True), (1, 0, True), (None, 5, False)]), (history.bytes_changed, [(50000, 55000, False), (50000, 160000, True), (40000, 65000, True), (None, 1, False)]),
        (history.millis_changed, [(200, 350, False), (100, 190, False), (500, 2000, True), (None, 9, False), (0, 5000, False)]),
    ],
)
def test_change_predicates(spark, f, cases):
    d = spark.createDataFrame([(a, b) for a, b, _ in cases], "a int, b int")
    assert [r[0] for r in d.select(f(F.col("a"), F.col("b"))).collect()] == [w for _, _, w in cases]


def test_compare(spark):
    s = "pair int, issue_key string, url string, severity string, ord int"
    now = spark.createDataFrame([(1, "k1", "u", "high", 1), (1, "k1", "u", "low", 2), (1, "k2", "u", "low", 3)], s)
    old = spark.createDataFrame([(1, "k1", "u", "high", 1), (1, "k3", "v", "low", 1)], s)
    got = sorted((r["event_type"], r["issue_key"], r["severity"]) for r in history.compare_issues(now, old).collect())
    assert got == [("issue_new", "k2", "low"), ("issue_ongoing", "k1", "low"), ("issue_resolved", "k3", "low"), ("severity_changed", "k1", "low")]
    same = history.compare_issues(now, now).collect()
    assert {r["event_type"] for r in same} == {"issue_ongoing"} and len(same) == 2
    t = "pair int, url_key string, url string, ord int, status int, title string, in_sitemap boolean, structured_types array<string>"
    a = spark.createDataFrame([(1, "a", "a", 1, 200, "x  y", True, ["A", "B"]), (1, "n", "n", 2, 200, None, True, [])], t)
    b = spark.createDataFrame([(1, "a", "a", 1, None, " x y", False, ["B", "A", "A"]), (1, "gone", "gone", 2, 200, None, True, [])], t)
    got = sorted((r["event_type"], r["url"]) for r in history.compare_pages(a, b).collect())
    assert got == [("http_status_changed", "a"), ("page_added_to_sitemap", "a"), ("page_new", "n"), ("page_removed", "gone")]


def score_of(spark, n=10, bad=0, home_status=200, home_state="indexable", issues=()):
    rows = [(1, i, "homepage" if i == 0 else "generic", "https://h.com/", "network_error" if 0 < i <= bad else "ok", home_status if i == 0 else 200, home_state if i == 0 else "indexable", 0, True, "en", 0) for i in range(n)]
    p = spark.createDataFrame(rows, "run int, ord int, page_type string, final_url string, outcome string, status int, indexing_state string, images_missing_alt int, has_viewport boolean, lang string, n_broken int")
    i = spark.createDataFrame([(1, t, s, u, k) for k, (t, s, u) in enumerate(issues)], "run int, issue_type string, severity string, url string, ord int")
    return scoring.scores(p, i).first()


def test_scores(spark):
    assert score_of(spark)["overall_score"] == 100
    r = score_of(spark, issues=[("server_error", "critical", "u")])
    assert r["overall_score"] <= 69 and r["cap_applied"] == "any_critical_issue"
    assert score_of(spark, home_status=500)["overall_score"] <= 50 and score_of(spark, home_state="noindex_unexpected")["overall_score"] <= 40
    assert score_of(spark, bad=9)["overall_score"] <= 20
    assert scoring.empty_score(spark).first()["cap_applied"] == "site_uncrawlable"
    p = scoring.penalties(spark.createDataFrame([(1, "title_too_short", "low", f"u{k}", k) for k in range(25)] + [(1, "strange", "low", "u", 0)], "run int, issue_type string, severity string, url string, ord int")).collect()
    assert len(p) == 1 and abs(p[0]["penalty"] - (1 + 4 * 0.75 + 15 * 0.4 + 5 * 0.2)) < 1e-9
    assert [r[0] for r in spark.createDataFrame([(s,) for s in (90, 89, 70, 50, 0)], "s int").select(scoring.score_label("s")).collect()] == ["Excellent", "Healthy", "Needs Attention", "Poor", "Critical"]


def test_discovery(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (3, 0), (3, 4), (4, 5)], "src long, dst long")
    s = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["depth"] for r in discovery.bfs(e, s, 2).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert {r["node"] for r in discovery.bfs(e, s, 9, most_nodes=2).collect()} == {0, 1, 2}
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, location string")
    got = {r["url"]: tuple(r)[1:] for r in discovery.redirect_chains(hops, spark.createDataFrame([("a",), ("x",), ("q",)], "url string")).collect()}
    assert got["a"] == ("c", 2, None) and got["q"] == ("q", 0, None) and got["x"][2] == "redirect loop"
    rules_ = spark.createDataFrame([("h.com", "disallow", "/p", 1)], "site string, kind string, value string, line_no int")
    pages = spark.createDataFrame([("h.com", "https://h.com/private"), ("h.com", "https://h.com/x"), ("o.com", "https://o.com/p")], "site string, url string")
    assert {r["url"] for r in discovery.allowed_only(pages, rules_).collect()} == {"https://h.com/x", "https://o.com/p"}


def test_control(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 12, m)
    runs = spark.createDataFrame([(1, t(0), t(50), "running"), (2, t(30), t(31), "running"), (3, t(50), None, "running"), (4, t(0), None, "success"), (5, t(20), t(50), "running")], "id int, started_at timestamp_ntz, last_progress_at timestamp_ntz, status string")
    got = {r["id"]: r["reason"] for r in control.stale_runs(runs, F.lit(t(55)).cast("timestamp_ntz")).collect()}
    assert set(got) == {1, 2} and "timeout" in got[1] and "no progress" in got[2]
    f = spark.range(1).select(dashboard.freshness(F.lit(t(0)), F.lit(t(10)), 24).alias("f")).first()["f"]
    assert (f["minutes_ago"], f["is_stale"]) == (10, False)


def test_change_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, "issue_new"), (2, "page_new")], "id int, event_type string")
    d.write.parquet(str(tmp_path / "c"))
    q = control.change_feed(spark, str(tmp_path / "c"), "id int, event_type string").writeStream.format("memory").queryName("feed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) as n from feed").first()["n"] == 2


def test_whole_audit(spark):
    rows = [
        (1, 0, "https://h.com/", "https://h.com/", "h.com", 200, "ok", 0, PAGE.replace("NOINDEX", "all"), {"content-encoding": " GZIP "}, True, False),
        (1, 1, "https://h.com/in", "https://h.com/in", "h.com", 404, "http_error", 0, "<p>x", {}, True, False),
        (1, 2, "https://h.com/one", "https://h.com/one", "h.com", 200, "ok", 0, "", {"x-powered-by": "p"}, False, False),
        (1, 3, "https://h.com/lost", "https://h.com/lost", "h.com", 200, "ok", 0, "<title>A title of its own here</title>", {}, True, False),
    ]
    f = spark.createDataFrame(rows, "run int, ord int, url string, final_url string, site_host string, status int, outcome string, redirect_count int, html string, headers map<string,string>, in_sitemap boolean, discovered boolean")
    sitemap = spark.createDataFrame([(1, "https://h.com/"), (1, "https://h.com/in"), (1, "https://h.com/lost")], "run int, key string")
    pages, issues, scores = audit.audit(f, sitemap, F.lit(dt.datetime(2024, 1, 1)))
    got = {(r["page_ord"], r["issue_type"]) for r in issues.collect()}
    assert {(0, "broken_internal_links"), (1, "client_error"), (2, "missing_title"), (2, "x_powered_by_exposed"), (3, "orphaned_sitemap_page"), (0, "generic_anchor_text"), (0, "mixed_content")} <= got
    assert (1, "missing_title") not in got
    assert {r["ord"]: r["inbound"] for r in pages.collect()} == {0: 0, 1: 1, 2: 1, 3: 0}
    assert 0 <= scores.first()["overall_score"] <= 100


def test_views(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    runs = spark.createDataFrame([(1, 1, t(1), "success"), (2, 1, t(2), "running"), (3, 2, t(1), "success"), (4, 2, t(1), "success")], "id int, site_id int, started_at timestamp_ntz, status string")
    assert {(r["site_id"], r["id"]) for r in views.latest_runs(runs).collect()} == {(1, 2), (2, 4)}
    assert {(r["site_id"], r["id"]) for r in views.latest_runs(runs, True).collect()} == {(1, 1), (2, 4)}
    assert {r["run_id"]: r["baseline_id"] for r in history.baseline_runs(runs).collect()} == {1: None, 2: 1, 3: 4, 4: 3}
