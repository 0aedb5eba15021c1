"""Audit-shaped tables made from the driver's tables by fixed formulas (used by queries and their SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..lineage import cut

SHOP = "https://shop.example.com/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 10_000


def spread(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """df dealt out by a key to as many tasks as its rows ask for: millions of short keys are few bytes, which one task would read, and work long on.

    A task gets about rows_per_task rows; fewer, while the cores are not all busy.
    """
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-n // rows_per_task), min(cores, -(-n // 1000))), key)


def audit_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """pages as crawled pages: outcomes, flags and headers from the id; facts from the flat markup. dealt: by id to tasks of about as many pages each (spread)."""
    p = table(spark, sf_dir, "pages")
    p = spread(p, "page_id") if dealt else p
    k = lambda n: F.col("page_id") % n
    outcome = F.when(k(37) == 0, "network_error").when((k(29) == 0) | (k(13) == 0), "http_error").otherwise("ok")
    status = F.when(k(37) == 0, F.lit(None).cast("int")).when(k(29) == 0, 500).when(k(13) == 0, 404).otherwise(200)
    d = p.select(
        "page_id", "url", F.col("page_id").alias("ord"), urls.host("url").alias("run"), urls.host("url").alias("site_host"), outcome.alias("outcome"), status.alias("status"),
        F.when(outcome == "ok", F.col("html")).alias("html"), F.when(k(11) == 0, 1).otherwise(0).alias("redirect_count"), (k(3) != 0).alias("in_sitemap"), (k(4) == 0).alias("discovered"),
        ((k(7) == 0) & (outcome == "ok")).alias("noindex"), F.when(k(2) == 0, "gzip").alias("compression"), F.when(k(10) == 0, "Server/1").alias("x_powered_by"),
        (F.lit(50) + (F.col("page_id") * 37) % 2000).cast("int").alias("response_time_ms"), F.col("url").alias("final_url"), urls.page_type("url").alias("page_type"),
    )
    title = html.flat_title("html")
    return d.withColumns({
        "title": title, "lang": html.flat_lang("html"), "charset": html.flat_charset("html"), "has_doctype": F.coalesce(html.has_html5_doctype("html"), F.lit(False)),
        "h1_count": F.coalesce(F.size(F.regexp_extract_all("html", F.lit("(?i)<h1[ >]"), F.lit(0))), F.lit(0)),
        "word_count": flat_words("html"), "html_size_bytes": F.coalesce(F.octet_length("html"), F.lit(0)),
    }).withColumns({"title_length": F.coalesce(text.utf16_length("title"), F.lit(0)), "title_px": F.when(F.col("title").isNotNull(), text.pixel_width("title")), "is_indexable": (F.col("outcome") == "ok") & ~F.col("noindex")})


def flat_words(html_col: str):
    """Words of the visible text of flat markup: tags go without leaving a space."""
    body = F.regexp_replace(html_col, r"(?is)<(?:head[ >].*?</head>|script[ >].*?</script>|style[ >].*?</style>)", "")
    return F.coalesce(text.word_count(F.regexp_replace(body, r"<[^>]*>", "")), F.lit(0))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return d.select("doc_id", "pos", F.trim(F.regexp_replace(F.lower("raw"), r"[ \t\r\f\x0B]+", " ")).alias("block"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    d = p.select(
        F.lit(1).alias("run"), i.alias("ord"), F.concat(F.lit(SHOP), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("/"), i.cast("string")).alias("url"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") == 48, F.lit(None).cast("int")).when(F.col("p_size") == 49, 404).when(F.col("p_size") == 50, 500).otherwise(200).alias("status"),
        (i % 3 != 0).alias("in_sitemap"), (i % 7 == 0).alias("noindex"),
    )
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    return d.select(
        "*", F.col("ord").cast("string").alias("url_key"), F.col("ord").cast("string").alias("final_key"), F.when(ok, "ok").when(F.col("status").isNull(), "network_error").otherwise("http_error").alias("outcome"),
        (ok & ~F.col("noindex")).alias("is_indexable"), F.lit("shop.example.com").alias("site_host"), F.lit("shop.example.com").alias("canonical_host"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, src_ord, key, pos, link: distinct links between part pages."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    li = table(spark, sf_dir, "lineitem").filter((F.col("l_linenumber") == 1) & (F.col("l_partkey") % 5 != 0)).select("l_orderkey", "l_partkey")
    e = li.join(F.broadcast(n)).select((F.col("l_orderkey") % F.col("n")).alias("src_ord"), F.col("l_partkey").alias("dst")).distinct()
    return e.select(F.lit(1).alias("run"), "src_ord", F.col("dst").cast("string").alias("key"), F.col("dst").alias("pos"), F.col("dst").cast("string").alias("link"))


def linked_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(starts, links, fetched, rules) of six crawls over all parts and line items: some targets are assets, have many parameters, redirect or are disallowed."""
    p = table(spark, sf_dir, "part")
    n_parts = p.count()
    end = F.when(F.col("p_size") % 10 == 0, ".pdf").when(F.col("p_size") % 10 == 1, "?a=1&b=2&c=3").when(F.col("p_size") % 10 == 2, "?a=1&b=2").otherwise("")
    key = F.concat(F.lit(SHOP), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("/"), F.col("p_partkey").cast("string"), end)
    keys = p.select(F.col("p_partkey").alias("p"), key.alias("key"), (F.col("p_size") % 7 == 0).alias("moved"))
    to = keys.select(((F.col("p") + n_parts - 1) % n_parts).alias("p"), F.col("key").alias("to_key"))
    nodes = keys.join(to, "p").select("p", "key", F.when(F.col("moved"), F.col("to_key")).otherwise(F.col("key")).alias("final_key"))
    rules = p.filter("p_partkey < 6").select(F.col("p_partkey").alias("run"), F.lit("disallow").alias("kind"), F.concat(F.lit("/"), F.split(F.lower("p_type"), " ")[0]).alias("value"))
    six = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))
    starts = nodes.filter(F.col("p") % 200 < 6).select((F.col("p") % 200).alias("run"), "key", "final_key", F.col("p").alias("ord"))
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("run"), (F.col("l_orderkey") % n_parts).alias("src"), F.col("l_partkey").alias("dst")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    links = li.join(nodes.select(F.col("p").alias("src"), F.col("key").alias("src_key")), "src").join(nodes.select(F.col("p").alias("dst"), "key"), "dst").select("run", "src_key", "key", "pos")
    return starts, links, nodes.select(six.alias("run"), "key", "final_key"), rules


def site_of(url: str):
    """The last two labels of a host, as a site."""
    return F.regexp_extract(url, r"^https?://[^/?#]*?([a-z0-9]+\.[a-z]+)(?:[/?#:]|$)", 1)


def robots_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, part, body: a line for each page in parts of 100 ids: agents, rules from its path, sitemaps and comments in turn."""
    k, site, path = F.col("page_id") % 5, site_of("url"), urls.safe_pathname("url")
    agent = F.when(F.col("page_id") % 3 == 0, "User-agent: other").when(F.col("page_id") % 3 == 1, "user-AGENT: *").otherwise("User-agent:  sitebot")
    line = F.when(k == 0, agent).when(k == 2, F.concat(F.lit("Disallow: "), path)).when(k == 3, F.concat(F.lit(" Sitemap: https://"), site, F.lit("/s"), F.col("page_id").cast("string"), F.lit(".xml"))).when(k == 1, F.concat(F.lit("# "), path)).otherwise(path)
    d = table(spark, sf_dir, "pages").select(site.alias("site"), F.floor(F.col("page_id") / 100).alias("part"), "page_id", line.alias("line"))
    return d.groupBy("site", "part").agg(F.array_sort(F.collect_list(F.struct("page_id", "line"))).alias("l")).select("site", "part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def sitemap_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sites, fetches): for each site an index of eight files that list its pages, with some of other hosts, repeats and one file that is cut off."""
    d = table(spark, sf_dir, "pages").select(site_of("url").alias("site"), "page_id", F.when(F.col("page_id") % 9 == 0, F.col("url")).otherwise(F.concat(F.lit("https://"), site_of("url"), urls.safe_pathname("url"))).alias("loc"))
    base = F.concat(F.lit("https://"), F.col("site"))
    escaped = F.replace(F.col("loc"), F.lit("&"), F.lit("&amp;"))
    files = d.groupBy("site", (F.col("page_id") % 8).alias("k")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), escaped, F.lit(" </loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    files = files.select("site", F.concat(base, F.lit("/s"), F.col("k").cast("string"), F.lit("-0.xml")).alias("url"), "xml")
    sites = d.select("site", base.alias("base_url")).distinct()
    names = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(F.lit("<sitemap><loc>"), base, F.lit("/s"), k.cast("string"), F.lit("-0.xml</loc></sitemap>")))
    index = sites.select("site", F.concat("base_url", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(names, ""), F.lit("<sitemap><loc>"), base, F.lit("/sitemap.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    broken = sites.select("site", F.concat("base_url", F.lit("/sitemap_index.xml")).alias("url"), F.lit("<urlset><url>").alias("xml"))
    return sites, files.union(index).union(broken).select("url", F.col("xml").cast("binary").alias("body"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    started = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site_id"), started.alias("started_at"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("partial").alias("status"),
        F.timestamp_add("MINUTE", (F.col("o_orderkey") % 120).cast("int"), started).alias("last_progress_at"),
    )


REAL_TYPES = {"t1": "server_error", "t2": "missing_title", "t3": "title_too_short", "t4": "low_word_count", "t5": "broken_internal_links", "t6": "sitemap_url_noindex", "t7": "html_response_uncompressed"}


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("site_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"))
    url = F.concat(F.lit(SHOP), (F.col("l_partkey") % 40).cast("string"))
    kind = F.concat(F.lit("t"), F.col("l_linenumber").cast("string"))
    sev = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "high").when(F.col("l_linestatus") == "O", "medium").otherwise("low")
    return li.join(o, "l_orderkey").select(F.col("l_orderkey").alias("run_id"), "site_id", "started_at", url.alias("url"), kind.alias("issue_type"), F.concat(url, F.lit("::"), kind).alias("issue_key"), sev.alias("severity"), F.col("l_suppkey").alias("tie"), F.col("l_partkey").alias("part"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "issue_new").when(F.col("event_type") == "purchase", "issue_resolved").when(F.col("event_type") == "view", "issue_ongoing").when(F.col("event_type") == "error", "http_status_changed").otherwise("field_changed")
    k = F.get_json_object("props", "$.k").cast("int")
    sev = F.when(k % 4 == 0, "critical").when(k % 4 == 1, "high").when(k % 4 == 2, "medium").otherwise("low")
    issue = F.startswith(kind, F.lit("issue_"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), (F.col("user_id") % 20).alias("site_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.concat(F.lit("/u"), (F.col("event_id") % 40).cast("string")).alias("url"),
        kind.alias("event_type"), F.when(issue, "issue").otherwise("page").alias("entity_type"), F.when(issue, sev).alias("severity"),
    )


def crawl_pair(spark: SparkSession, sf_dir: str, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(current, previous): the audit pages as two crawls that differ by fixed formulas."""
    p = audit_pages(spark, sf_dir)
    k = lambda n: F.col("ord") % n
    state = F.when((F.col("outcome") == "ok") & F.col("noindex") & F.col("in_sitemap"), "noindex_unexpected").when((F.col("outcome") == "ok") & F.col("noindex"), "noindex_expected").otherwise("indexable")
    cols = ["pair", "url_key", "url", "ord", "status", "final_url", "title", "h1_count", "word_count", "noindex", "is_indexable", "indexing_state", "page_type", "in_sitemap", "discovered", "html_size_bytes", "response_time_ms"]
    base = p.withColumns({"pair": F.lit(1), "url_key": urls.normalize("url"), "indexing_state": state}).select(*cols)
    base = cut(base, "crawl") if stored else base
    current = base.filter(k(10) != 1).select(*cols)
    previous = base.filter(k(10) != 0).withColumns({
        "title": F.when(k(7) == 0, F.concat(F.coalesce("title", F.lit("")), F.lit(" old"))).otherwise(F.col("title")), "word_count": F.when(k(5) == 0, F.col("word_count") * 2).otherwise(F.col("word_count")),
        "status": F.when(k(17) == 0, 503).otherwise(F.col("status")), "html_size_bytes": F.when(k(19) == 0, F.lit(None).cast("int")).otherwise(F.col("html_size_bytes")),
    }).select(*cols)
    return current, previous
