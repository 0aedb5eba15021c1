"""What a crawl starts from: robots rules, sitemaps, and discovery through links."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..lineage import cut


def robots_lines(robots: DataFrame) -> DataFrame:
    """site, part, line_no, key, value of the lines that say something; lines starting with # and lines without a colon go.

    A body may come in parts of whole lines (column part); line numbers begin at 0 in each.
    """
    d = robots if "part" in robots.columns else robots.withColumn("part", F.lit(0))
    d = d.select("site", "part", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    d = d.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & (F.instr("line", ":") > 0))
    return d.select("site", "part", "line_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def robots_rules(robots: DataFrame, user_agent: str) -> DataFrame:
    """site, part, line_no, kind (sitemap or disallow), value. A user-agent line decides for all lines up to the next one.

    The last user-agent line is carried in two steps, within parts and from part
    to part, so no task holds the lines of a whole site.
    """
    applies = F.when(F.col("key") == "user-agent", (F.col("value") == "*") | F.contains(F.lit(user_agent.lower()), F.lower("value")))
    d = robots_lines(robots).withColumn("says", applies)
    d = d.withColumn("here", F.last("says", ignorenulls=True).over(Window.partitionBy("site", "part").orderBy("line_no")))
    ends = d.groupBy("site", "part").agg(F.max_by("says", F.when(F.col("says").isNotNull(), F.col("line_no"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("site", "part", before.alias("before"))
    d = d.join(carried, ["site", "part"]).withColumn("applies", F.coalesce("here", "before", F.lit(False)))
    keep = (F.col("key") == "sitemap") | ((F.col("key") == "disallow") & F.col("applies"))
    return d.filter(keep & (F.col("value") != "")).select("site", "part", "line_no", F.col("key").alias("kind"), "value")


def disallowed(path: Column, rules: Column) -> Column:
    """Whether some rule of an array is a prefix of the path."""
    return F.exists(rules, lambda r: (r != "") & F.startswith(path, r))


def allowed_only(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (site, url) that no disallow rule of their site covers. Rules of a site are few: they come as one array."""
    r = rules.filter("kind = 'disallow'").groupBy("site").agg(F.collect_set("value").alias("_rules"))
    d = pages.join(r, "site", "left")
    return d.filter(~F.coalesce(disallowed(urls.safe_pathname("url"), F.col("_rules")), F.lit(False))).drop("_rules")


def sitemap_starts(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """site, url, ordinal: those that robots name, then the two usual places; the first of equal ones stays."""
    place = F.struct(F.lit(0).alias("k"), F.col("part").cast("long").alias("part"), F.col("line_no").cast("long").alias("line_no"))
    named = rules.filter("kind = 'sitemap'").select("site", F.col("value").alias("url"), place.alias("o"))
    usual = sites.select("site", F.posexplode(F.array(*(F.concat("base_url", F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml")))).alias("k", "url"))
    usual = usual.select("site", "url", F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("part"), F.col("k").cast("long").alias("line_no")).alias("o"))
    return named.union(usual).groupBy("site", "url").agg(F.min("o").alias("ordinal"))


def unpacked(fetches: DataFrame) -> DataFrame:
    """url, xml: stored bodies (url, body binary) as text; gzip members, however many, are inflated, and a broken one gives no text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = [body_text(batch.column(1)[at].as_py())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array(text, pa.string())], names=["url", "xml"])

    packed = F.coalesce(F.hex(F.substring("body", 1, 2)) == "1F8B", F.lit(False))
    plain = fetches.filter(~packed).select("url", F.try_validate_utf8(F.col("body").cast("string")).alias("xml"))
    return plain.union(fetches.filter(packed).select("url", "body").mapInArrow(work, "url string, xml string"))


def body_text(body: bytes) -> str | None:
    out = []
    try:
        while body:
            member = zlib.decompressobj(31)
            out.append(member.decompress(body) + member.flush())
            if not member.eof:
                return None
            body = member.unused_data.lstrip(b"\0")
        return b"".join(out).decode()
    except (zlib.error, UnicodeDecodeError):
        return None


def sitemap_entries(files: DataFrame) -> DataFrame:
    """url (of the file), kind (index or page), loc, pos. An index wins over a urlset; what is no XML gives nothing."""
    xml = F.when(F.col("xml").rlike(r"(?s)^\s*<") & F.col("xml").rlike(r"(?s)</\s*[\w:]*(sitemapindex|urlset)\s*>\s*(?:<!--.*?-->\s*)*$"), F.col("xml"))
    locs = lambda root, item: F.xpath(xml, F.lit(f"//*[local-name()='{root}']/*[local-name()='{item}']/*[local-name()='loc']/text()"))
    d = files.select("url", locs("sitemapindex", "sitemap").alias("i"), locs("urlset", "url").alias("p"))
    one = F.when(F.size("i") > 0, F.transform("i", lambda x: F.struct(F.lit("index").alias("kind"), F.trim(x).alias("loc")))).otherwise(F.transform("p", lambda x: F.struct(F.lit("page").alias("kind"), F.trim(x).alias("loc"))))
    return d.select("url", F.posexplode(one).alias("pos", "e")).select("url", "e.kind", "e.loc", "pos").filter("loc != ''")


def sitemap_urls(files: DataFrame, starts: DataFrame) -> DataFrame:
    """site, url: normalized page URLs of the site's own host, from its sitemaps through all their indexes, however deep; each file is read once, so circles end."""
    entries = sitemap_entries(files).withColumn("url", urls.normalized_or_raw("url"))
    frontier = starts.select("site", urls.normalized_or_raw("url").alias("url")).distinct()
    seen = frontier
    while True:  # as many turns as indexes are nested
        nxt = cut(frontier.join(entries.filter("kind = 'index'"), "url").select("site", urls.normalized_or_raw("loc").alias("url")).distinct().join(seen, ["site", "url"], "left_anti"))
        if nxt.isEmpty():
            break
        seen, frontier = seen.union(nxt), nxt
    pages = seen.join(entries.filter("kind = 'page'"), "url").select("site", urls.normalize("loc").alias("page"))
    return pages.filter(urls.host("page") == F.lower("site")).select("site", F.col("page").alias("url")).distinct()


def discover(
    starts: DataFrame, links: DataFrame, most_depth: int, most_pages: int | None = None, fetched: DataFrame | None = None, rules: DataFrame | None = None, crawlable=urls.is_crawlable
) -> DataFrame:
    """run, key, final_key, depth, turn: pages found through links from the starts of every run, level by level, for all runs at once.

    starts: run, key, final_key, ord. links: run, src_key, key, pos. fetched:
    run, key, final_key of what was redirected. rules: run, kind, value; only
    disallow rules count, and they are for links, not for starts. A target
    counts once it is crawlable, allowed and neither the requested nor the final
    key of a page known so far. `most_pages` limits what each run discovers;
    its starts do not count. A run's budget goes to targets in the order in which
    they are first seen: by their parent's turn, then by the link's place.

    A level joins the frontier with the links, combines equal targets before
    they move, and ranks at most `most_pages` rows of a run from each task.
    """
    known = starts.groupBy("run", "key").agg(F.min_by("final_key", "ord").alias("final_key"), F.min("ord").alias("turn")).withColumn("depth", F.lit(0))
    known = cut(known.select("run", "key", F.coalesce("final_key", "key").alias("final_key"), "depth", F.col("turn").cast("long").alias("turn")), "discovered")
    frontier, forbidden = known, None
    if rules is not None:
        forbidden = rules.filter("kind = 'disallow' and value <> ''").groupBy("run").agg(F.collect_set("value").alias("_rules"))
    for depth in range(1, most_depth + 1):
        parents = frontier.select("run", F.col("key").alias("src_key"), "turn")
        found = parents.join(links.select("run", "src_key", "key", "pos"), ["run", "src_key"]).groupBy("run", "key").agg(F.min(F.struct("turn", "pos")).alias("_seen"))
        if crawlable is not None:
            found = found.filter(crawlable("key"))
        if forbidden is not None:
            found = found.join(forbidden, "run", "left").filter(~F.coalesce(disallowed(urls.safe_pathname("key"), F.col("_rules")), F.lit(False))).drop("_rules")
        visited = known.select("run", "key").union(known.select("run", F.col("final_key").alias("key")))
        found = found.join(visited, ["run", "key"], "left_anti")
        turn = F.lit(0).cast("long")
        if most_pages is not None:
            spent = known.filter("depth > 0").groupBy("run").agg(F.count("*").alias("_spent"))
            found = found.withColumn("_turn", F.row_number().over(Window.partitionBy("run").orderBy("_seen", "key"))).filter(F.col("_turn") <= most_pages)
            found = found.join(spent, "run", "left").filter(F.col("_turn") <= most_pages - F.coalesce("_spent", F.lit(0)))
            turn = F.col("_turn").cast("long")
        final = F.col("key")
        if fetched is not None:
            found = found.join(fetched.select("run", "key", F.col("final_key").alias("_final")), ["run", "key"], "left")
            final = F.coalesce("_final", "key")
        frontier = cut(found.select("run", "key", final.alias("final_key"), F.lit(depth).alias("depth"), turn.alias("turn")), "discovered")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def bfs(edges: DataFrame, starts: DataFrame, most_depth: int, most_nodes: int | None = None) -> DataFrame:
    """node, depth: first reached from `starts` (node) over edges (src, dst, perhaps pos) of one graph; `most_nodes` limits the nodes found besides the starts."""
    pos = F.col("pos") if "pos" in edges.columns else F.col("dst")
    links = edges.select(F.lit(0).alias("run"), F.col("src").alias("src_key"), F.col("dst").alias("key"), pos.cast("long").alias("pos"))
    s = starts.select(F.lit(0).alias("run"), F.col("node").alias("key"), F.col("node").alias("final_key"), F.col("node").cast("long").alias("ord"))
    return discover(s, links, most_depth, most_nodes, crawlable=None).select(F.col("key").alias("node"), "depth")


def most_pages(pages: DataFrame, most: int, order: str = "ord", run: str = "run") -> DataFrame:
    """The first pages of each crawl by their order, up to a limit; 0: all of them."""
    if most <= 0:
        return pages
    rank = F.row_number().over(Window.partitionBy(run).orderBy(order))
    return pages.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def redirect_chains(hops: DataFrame, starts: DataFrame, limit: int = 10) -> DataFrame:
    """url, final_url, redirect_count, error: stored hops (url, location) followed up to `limit`; a loop or too many hops is an error."""
    now = starts.select("url", F.col("url").alias("at"), F.lit(0).alias("n"), F.array("url").alias("seen"), F.lit(None).cast("string").alias("error"))
    h = hops.select(F.col("url").alias("h_url"), "location")
    for _ in range(limit + 1):
        j = now.join(h, now["at"] == h["h_url"], "left")
        go = F.col("location").isNotNull() & F.col("error").isNull()
        loop = go & F.array_contains("seen", F.col("location"))
        far = go & (F.col("n") >= limit)
        now = j.select(
            "url", F.when(go & ~loop & ~far, F.col("location")).otherwise(F.col("at")).alias("at"), F.when(go & ~loop & ~far, F.col("n") + 1).otherwise(F.col("n")).alias("n"),
            F.when(go & ~loop & ~far, F.concat("seen", F.array("location"))).otherwise(F.col("seen")).alias("seen"),
            F.when(loop, "redirect loop").when(far, "too many redirects").otherwise(F.col("error")).alias("error"),
        )
    return now.select("url", F.col("at").alias("final_url"), F.col("n").alias("redirect_count"), "error")
