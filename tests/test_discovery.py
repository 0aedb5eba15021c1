"""Discovery of many crawls at once against a plain crawler; stored bodies; tables of loops."""

import gzip
import os
import random
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from sitespan import lineage
from sitespan.sources import discovery


def plain_crawl(starts, links, finals, rules, most_depth, most_pages):
    """One crawl, page by page: starts in order, {src: [targets in order]}."""
    visited = set(starts) | {finals.get(s, s) for s in starts}
    out = {s: (finals.get(s, s), 0) for s in starts}
    level, found = list(starts), 0
    for depth in range(1, most_depth + 1):
        new = []
        for page in level:
            for to in links.get(page, []):
                path = urlsplit(to).path or "/"
                if to in visited or to in new or to.endswith(".png") or to.count("=") > 2 or any(path.startswith(r) for r in rules):
                    continue
                new.append(to)
        new = new[: most_pages - found]
        visited |= set(new) | {finals.get(s, s) for s in new}
        for s in new:
            out[s] = (finals.get(s, s), depth)
        found += len(new)
        level = new
        if not new or found >= most_pages:
            break
    return out


def test_all_crawls_at_once(spark):
    rng = random.Random(4)
    runs, start_rows, link_rows, final_rows, rule_rows = {}, [], [], [], []
    for run in range(5):
        n = 10 if run == 3 else 60
        urls = [f"https://h{run}.com/{rng.choice(['a', 'b', 'no'])}/{k}{rng.choice(['', '', '', '.png', '?x=1&y=2', '?x=1&y=2&z=3'])}" for k in range(n)]
        links = {u: rng.choices(urls, k=rng.randint(0, 6)) + ([urls[0]] if run == 1 else []) for u in urls}  # every page of run 1 links to its first
        finals = {u: rng.choice(urls) for u in rng.sample(urls, n // 5)}
        starts = [] if run == 4 else rng.sample(urls, 5)
        rules = ["/no"] if run % 2 else []
        runs[run] = (starts, links, finals, rules)
        start_rows += [(run, u, finals.get(u, u), k) for k, u in enumerate(starts)]
        link_rows += [(run, u, t, k) for u, ts in links.items() for k, t in enumerate(ts)]
        final_rows += [(run, u, f) for u, f in finals.items()]
        rule_rows += [(run, "disallow", r) for r in rules] + [(run, "disallow", ""), (run, "sitemap", "/a")]
    s = spark.createDataFrame(start_rows, "run int, key string, final_key string, ord int")
    li = spark.createDataFrame(link_rows, "run int, src_key string, key string, pos int")
    fe = spark.createDataFrame(final_rows, "run int, key string, final_key string")
    ru = spark.createDataFrame(rule_rows, "run int, kind string, value string")
    for most_depth, most_pages in ((3, 12), (3, 10_000), (1, 4), (0, 5), (2, 0)):
        got = {}
        for r in discovery.discover(s, li, most_depth, most_pages, fe, ru).collect():
            assert (r.run, r.key) not in got
            got[r.run, r.key] = (r.final_key, r.depth)
        want = {(run, k): v for run, x in runs.items() for k, v in plain_crawl(*x[:3], x[3], most_depth, most_pages).items()}
        assert got == want, (most_depth, most_pages)
    unlimited = {(r.run, r.key): r.depth for r in discovery.discover(s, li, 3, None, fe, ru).collect()}
    assert unlimited == {(run, k): v[1] for run, x in runs.items() for k, v in plain_crawl(*x[:3], x[3], 3, 10_000).items()}


def test_robots_in_parts_as_in_one_body(spark):
    rng = random.Random(9)
    rows = []
    for site in range(6):
        lines = [rng.choice(["User-agent: *", "user-agent: other", "User-Agent: SiteBot", "User-agent:", f"Disallow: /p{k}", f"Disallow: /q{k}", "Disallow:", f"sitemap: https://h/{k}.xml", "# x: y", "nothing", ""]) for k in range(80)]
        rows.append((f"s{site}", lines))
    whole = spark.createDataFrame([(s, "\r\n".join(x)) for s, x in rows], "site string, body string")
    parts = spark.createDataFrame([(s, k, "\n".join(x[a : a + 7])) for s, x in rows for k, a in enumerate(range(0, 80, 7))], "site string, part int, body string")
    got = {(r.site, r.part * 7 + r.line_no, r.kind, r.value) for r in discovery.robots_rules(parts, "SiteBot/1.0").collect()}
    assert got == {(r.site, r.line_no, r.kind, r.value) for r in discovery.robots_rules(whole, "SiteBot/1.0").collect()}
    want = set()
    for s, lines in rows:
        on = False
        for n, line in enumerate(lines):
            key, _, value = line.strip().partition(":")
            key, value = key.strip().lower(), value.strip()
            if line.startswith("#") or ":" not in line:
                continue
            if key == "user-agent":
                on = value == "*" or value.lower() in "sitebot/1.0"
            elif value and (key == "sitemap" or key == "disallow" and on):
                want.add((s, n, key, value))
    assert got == want


def test_packed_bodies(spark):
    one = b"<urlset><url><loc>https://h.com/\xc3\xa9</loc></url></urlset>"
    rows = [("plain", one), ("packed", gzip.compress(one)), ("members", gzip.compress(one[:9]) + gzip.compress(one[9:])), ("cut", gzip.compress(one)[:-9]), ("none", None), ("empty", b""), ("binary", b"\xff\xfe"), ("bad", b"\x1f\x8bxx")]
    got = {r.url: r.xml for r in discovery.unpacked(spark.createDataFrame(rows, "url string, body binary")).collect()}
    assert got == {"plain": one.decode(), "packed": one.decode(), "members": one.decode(), "cut": None, "none": None, "empty": "", "binary": None, "bad": None}
    assert [r.loc for r in discovery.sitemap_entries(discovery.unpacked(spark.createDataFrame(rows[:4], "url string, body binary"))).collect()] == ["https://h.com/é"] * 3


def test_tables_of_loops_are_deleted(spark):
    with lineage.scope(spark):
        d = lineage.cut(spark.range(9).withColumn("x", F.col("id") * 2))
        path = d.cut_path.removeprefix("file://")
        assert os.path.isdir(path)
        assert d.agg(F.sum("x")).first()[0] == 72
    assert not os.path.exists(path)
    kept = lineage.cut(spark.range(3)).cut_path.removeprefix("file://")
    lineage.clear(spark)
    assert not os.path.exists(kept)
