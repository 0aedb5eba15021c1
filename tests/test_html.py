"""The flat parser against a tree of objects, on every kind of tag, nesting and attribute; rows of C16, C24, C25 and C29."""

import json
import os
import random
import sys
import time

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import plain_html  # noqa: E402

from sitespan.functions import html  # noqa: E402

TAGS = "html head body div p p p li ul ol nav header footer section table tr td th dl dt dd select option span b a a img br h1 h2 h6 blockquote figcaption title meta link noscript template button article".split()
ATTRS = [
    "", "", "", " id=x", ' role="navigation"', " role=banner", " href='/a b?x=1'", ' href="#f"', ' HREF="http://o.com:80/x/"', " href=/plain/path/", ' alt="é &amp; x"', " alt", " src=http://i.com/p.png", ' rel="stylesheet" href="http://c/x.css"',
    ' name=description content=" d "', " charset=utf-8", ' title="t t"', " aria-label=lab", " a=1 a=2", " rel=alternate hreflang=de href=/de", ' type="application/ld+json"', ' lang="fr"', ' x="a>b"', " name=viewport", " property=og:title content=og", " rel=canonical href=/c/",
]
WORDS = ["text ", "a", "&lt;b&gt;", " \n ", "é", "<!-- c > <p> -->", '{"@type":"X"}', "1 < 2 ", "\xa0", "&nbsp;", "<!---->", "</>", "<?pi x>"]


def made(rng):
    raw = lambda: f"<script{rng.choice(ATTRS)}>{rng.choice([*WORDS, '<p>'])}</script>"
    body = "".join(rng.choice([f"<{rng.choice(TAGS)}{rng.choice(ATTRS)}>", f"</{rng.choice(TAGS)}>", rng.choice(WORDS), raw()]) for _ in range(rng.randint(0, 40)))
    return rng.choice(["", "<!DOCTYPE html>", " <!doctype HTML>"]) + body


@pytest.mark.parametrize("seed", range(4))
def test_same_facts_as_a_tree(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        page = made(rng)
        assert html.raw_facts(page, "https://h.com/d/p?q=1") == plain_html.raw_facts(page, "https://h.com/d/p?q=1"), page


def test_what_the_standard_says_of_odd_markup():
    facts = lambda h: html.raw_facts(h, "https://h.com/")
    assert facts("<p>a<script>never closed <p>b")["body_text"] == "a"
    assert facts("<p>a<![CDATA[x>y]]>b")["body_text"] == "ay]]>b"  # a comment up to the first >
    assert facts("<p title='a>b' x=\"'\">c</p>")["blocks"] == ["c"]
    assert facts("<p>cut <a href=")["body_text"] == "cut "
    assert facts("a <3 b")["body_text"] == "a <3 b"
    assert facts(None)["blocks"] == [] and facts("")["title"] is None
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert facts(deep)["body_text"] == "x"
    assert facts("<p>" + "y" * 3_000_000)["blocks"] == ["y" * 3_000_000]
    assert facts("<a " + "b" * 200_000 + "=" * 200_000)["anchors"] == []  # no search that starts over at every byte


REST = '<p>b <a href="/y">y</a> <a href="http://o.com/z">z</a></p>'


@pytest.mark.parametrize(
    "odd",
    ["1 <é 2", "<ü>", "<p>中 <中文 ", "<svg><style/></svg>", '<svg><script src="/s.js" /><path/></svg>', "<math><style x=1 /></math>", "<title>a <!-- b</title>", '<title>a <b c="</title>', "<textarea><!-- </textarea>", "<title>a <script></title>", "<svg><style x=a/>q</style></svg>"],
)
def test_the_rest_of_a_page_is_read_after_odd_markup(odd):
    facts = html.raw_facts(f'<a href="/x">x</a>{odd}{REST}', "https://h.com/")
    assert facts["internal_links"] == ["https://h.com/x", "https://h.com/y"] and facts["external_links"] == ["http://o.com/z"]
    assert [a["text"] for a in facts["anchors"]] == ["x", "y", "z"] and facts["blocks"][-1] == "b y z"


def test_texts_of_odd_markup():
    facts = lambda h: html.raw_facts(h, "https://h.com/")
    assert facts("<p>1 <é 2</p>")["body_text"] == "1 <é 2" and facts("<p>a </")["body_text"] == "a </"
    assert facts("<title>a <!-- b</title><p>c <!-- d --></p>")["title"] == "a <!-- b"
    assert facts("<p>a<style/>b")["body_text"] == "a"  # outside of drawings a slash closes nothing
    began = time.time()
    for many in ("<title>" + "<a " * 200_000 + "</title>", "<title>" * 50_000, "<textarea>x</textarea>" * 50_000, "<é" * 200_000, "<title>" + "<script>" * 100_000 + "</title>"):
        facts(many)
    assert time.time() - began < 10  # no search that starts over at every tag


def test_structured_data_of_any_depth_and_length():
    types = lambda ld: html.raw_facts(f"<script type='application/ld+json'>{ld}</script>", "https://h.com/")["structured_types"]
    n = 100_000
    assert types('{"@type": "A", "@graph": [' * n + '{"@type": "B"}' + "]}" * n) == ["A", "B"]
    assert types('{"x": ' + "[" * n + "]" * n + ', "@type": "C"}') == ["C"] and types("[" * n + "]" * (n - 1)) == []
    assert types('{"@type": "D", "n": ' + "9" * 5000 + "}") == ["D"]


def test_pages_that_ended_the_query_or_lost_a_link(spark):
    ld = r'{"@type": ["A\ud800", "\udc00\ud83d\ude00", "\\ud800"], "@graph": [{"@type": "PodcastEpisode", "name": "n\uDFFF"}]}'
    links = [f"https://h.com:{'0' * 5000}443/long", f"https://h.com:{'9' * 5000}/none", "https://%68.com/a%20b", "https://h%2Fx.com/none", "https://%5Bh.com/none", "http://[::1]:80/out", "https://h%ff.com/none", "http://h.com:080/x", "http://h.com:0/y"]
    page = f"<script type='application/ld+json'>{ld}</script>" + "".join(f'<a href="{x}">x</a>' for x in links)
    got = html.with_facts(spark.createDataFrame([(page, "https://h.com/")], "html string, final_url string")).first()
    assert got.structured_types == ["A\ufffd", "\ufffd\U0001f600", "\\ud800", "PodcastEpisode"] and got.episodes[0].name == "n\ufffd"
    assert got.internal_links == ["https://h.com/long", "https://h.com/a%20b", "http://h.com/x", "http://h.com:0/y"] and got.external_links == ["http://[::1]/out"]


def test_deep_reading_is_that_of_json(monkeypatch):
    class Shallow(json.JSONDecoder):
        def decode(self, s):
            raise RecursionError

    monkeypatch.setattr(html, "_DECODER", Shallow())
    rng, seen = random.Random(0), {True: 0, False: 0}
    tokens = ["[", "]", "{", "}", ",", ":", '"a"', '"b":', "1", " ", "null", "-2.5e1", '"\\u00e9"', "tru", "[]", "{}", '{"a":', "[1,"]
    for _ in range(30_000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randint(0, 9)))
        try:
            want = json.loads(text)
        except ValueError:
            seen[False] += 1
            with pytest.raises(ValueError):
                html.json_of(text)
        else:
            seen[True] += 1
            assert html.json_of(text) == want
    assert min(seen.values()) > 500


def test_blocks_leave_landmarks_out():
    page = "<nav><p>no</p></nav><div role=banner><li>no</li></div><main><p>One <b>TWO</b><script>x</script></p><blockquote><p>three</p></blockquote><ul><li>four<nav>no</nav></ul></main><footer><h2>no</h2></footer>"
    assert html.raw_facts(page, "https://h.com/")["blocks"] == ["one two", "three", "three", "four"]


def test_episodes_headers_and_publication(spark):
    ld = '{"@graph": [{"@type": ["PodcastEpisode", "Thing"], "name": " ", "episodeNumber": 7, "datePublished": "%s", "url": "/e"}, {"@type": "Person", "name": "n"}]}'
    rows = [(k, f"<script type='application/ld+json'>{ld % when}</script>", {"server": "s", "content-encoding": " BR ", "x-other": "y"}) for k, when in enumerate(["2024-01-01T00:00:00Z", "2999-01-01", "soon", "Mon, 01 Jan 2024 10:00:00 GMT"])]
    rows.append((4, "<script type='application/ld+json'>{broken</script>", {}))
    d = html.with_facts(spark.createDataFrame([(*r, "https://h.com/") for r in rows], "k int, html string, headers map<string,string>, final_url string"))
    d = d.select("k", "episodes", "structured_types", html.publication_state(F.col("episodes"), F.lit("2025-01-01").cast("timestamp")).alias("state"), html.server_headers(F.col("headers")).alias("kept"), html.compression(F.col("headers")).alias("enc"))
    got = {r.k: r for r in d.collect()}
    assert [got[k].state for k in range(5)] == ["published", "scheduled", "unknown", "published", "unknown"]
    e = got[0].episodes
    assert [(x.type, x.name, x.episode_number, x.url) for x in e] == [("PodcastEpisode", None, "7", "/e")]
    assert got[0].structured_types == ["PodcastEpisode", "Thing", "Person"] and got[4].episodes == []
    assert (got[0].kept.server, got[0].enc, got[4].enc) == ("s", "br", None)
