"""From fetched pages to issues and a score: the whole audit as one plan over all sites and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..lineage import cut
from ..operators import graph, rules, samples, scoring


def analyzed(fetches: DataFrame, now) -> DataFrame:
    """Facts of fetched pages. fetches: run, ord, url, final_url, site_host, status, outcome, redirect_count, html, headers (map), in_sitemap, discovered."""
    d = html.with_facts(fetches.withColumn("html", F.when(F.col("outcome") == "ok", F.col("html"))))
    a = samples.anchor_counts("anchors")
    d = d.withColumns({
        "page_type": urls.page_type("final_url"), "url_key": urls.normalized_or_raw("url"), "final_key": urls.normalized_or_raw("final_url"), "canonical_host": urls.host("canonical"),
        "compression": html.compression(F.col("headers")), "x_powered_by": F.try_element_at("headers", F.lit("x-powered-by")), "publication_state": html.publication_state("episodes", now), "metrics": a,
    })
    seen = (F.col("outcome") == "ok") & (F.coalesce("html", F.lit("")) != "")
    d = d.withColumn("is_indexable", seen & F.col("status").between(200, 299) & ~F.col("noindex"))
    return d.withColumns({"anchor_empty": F.col("metrics.empty_internal"), "anchor_generic": F.col("metrics.generic"), "anchor_empty_samples": F.col("metrics.empty_samples"), "anchor_generic_samples": F.col("metrics.generic_samples"), "indexing_state": rules.indexing_state()})


def links_of(pages: DataFrame) -> DataFrame:
    return pages.select("run", F.col("ord").alias("src_ord"), F.col("final_key").alias("src_key"), F.posexplode("internal_links").alias("pos", "link")).withColumn("key", urls.normalized_or_raw("link"))


def all_issues(pages: DataFrame, sitemap: DataFrame, probes: DataFrame | None = None, others: bool = False, links: DataFrame | None = None) -> DataFrame:
    """run, page_ord, url, ord, issue_type, severity, message, value, recommendation of every stage of rules, in its order.

    probes: run and what rules.host_canonicalization reads; its issue goes to
    the run's first homepage. An issue of a shared title or description carries
    the class of pages that share it (classId), so issues grow with the pages;
    graph.duplicate_classes, duplicate_members and other_pages give the lists.
    others: whether such an issue also lists all other pages itself, a list as
    long as the class for each of its pages. links: links_of(pages), if stored.
    """
    links = links_of(pages) if links is None else links
    broken = None if "broken_internal_links" in pages.columns else graph.broken_by_page(pages, links).withColumnRenamed("src_ord", "ord")
    amb = samples.ambiguous_anchors(pages, ["run", "ord"]).groupBy("run", "ord").agg(F.array_sort(F.collect_list(F.struct("rank", "text", F.size("destinations").alias("n"), "destinations"))).alias("a")).select("run", "ord", F.transform("a", lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), x["destinations"].alias("destinations"))).alias("ambiguous"))
    rep = samples.repeated_blocks(pages.select("run", "ord", F.posexplode("blocks").alias("pos", "block")), ["run", "ord"]).groupBy("run", "ord").agg(F.count("*").cast("int").alias("repeated_blocks"), F.array_sort(F.collect_list(F.struct("rank", "text", "occurrences"))).alias("s"))
    rep = rep.select("run", "ord", "repeated_blocks", F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["occurrences"].alias("occurrences"))).alias("repeated_samples"))
    none = {"broken_internal_links": F.array().cast("array<string>"), "repeated_blocks": F.lit(0), "ambiguous": F.expr(rules.PAGE["ambiguous"]), "repeated_samples": F.expr(rules.PAGE["repeated_samples"])}
    d = pages if broken is None else pages.join(broken, ["run", "ord"], "left")
    d = d.join(amb, ["run", "ord"], "left").join(rep, ["run", "ord"], "left")
    d = d.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    key = ["run", F.col("ord").alias("page_ord"), "url"]
    own = rules.apply_page_rules(d.withColumn("page_ord", F.col("ord")), ["run", "page_ord", "url"]).withColumn("ord", F.col("rule_ord")).drop("rule_ord")
    nothing = F.lit(None).cast("string")
    dup = None
    for at, (column, field, kind, severity, head) in enumerate([("title", "title", "duplicate_title", "high", rules.text('Title "', F.col("title"), '"')), ("meta_description", "description", "duplicate_meta_description", "medium", F.lit("Meta description"))]):
        x = graph.duplicates(pages, column, collect_others=others).join(pages.select("run", "ord", "title"), ["run", "ord"])
        shown = {field: F.col("value"), "classId": F.col("class_id")} | ({"otherUrls": F.col("other_urls")} if others else {})
        value = rules.json(**shown)
        x = x.select("run", F.col("ord").alias("page_ord"), "url", F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), rules.text(head, " is shared by ", F.col("n"), " indexable pages.").alias("message"), value.alias("value"), F.lit(1000 + at).alias("ord"))
        dup = x if dup is None else dup.unionByName(x)
    dup = dup.withColumn("recommendation", rules.recommended())
    cov = graph.coverage(pages, links, sitemap)
    miss = cov.filter("missing").select(*key, F.lit("indexable_page_missing_from_sitemap").alias("issue_type"), F.lit("medium").alias("severity"), F.lit("Indexable internally linked page is missing from the XML sitemap.").alias("message"), nothing.alias("value"), F.lit(2000).alias("ord")).withColumn("recommendation", rules.recommended())
    orphan = cov.filter("orphaned").select(*key, F.lit("orphaned_sitemap_page").alias("issue_type"), F.lit("medium").alias("severity"), F.lit("Sitemap page has no internal links pointing to it from other crawled pages.").alias("message"), nothing.alias("value"), F.lit(2001).alias("ord")).withColumn("recommendation", rules.recommended())
    state = rules.indexing_issues(pages.withColumn("page_ord", F.col("ord")), ["run", "page_ord", "url"]).withColumn("ord", F.lit(3000))
    out = own
    for x in (dup, miss, orphan, state):
        out = out.unionByName(x)
    if probes is not None:
        home = pages.filter("page_type = 'homepage'").groupBy("run").agg(F.min_by(F.struct("ord", "url"), "ord").alias("h"))
        h = rules.host_canonicalization(probes).filter("verdict = 'issue'").join(home, "run")
        out = out.unionByName(h.select("run", F.col("h.ord").alias("page_ord"), F.col("h.url").alias("url"), F.lit(4000).alias("ord"), "issue_type", "severity", "message", "value", "recommendation"))
    return out


def audit(fetches: DataFrame, sitemap: DataFrame, now, probes: DataFrame | None = None, others: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, issues, scores) of all runs.

    Facts, pages and issues are each computed once and stored in the shared
    folder, since rules, graph and scores read them several times; lineage.scope
    or lineage.clear deletes the tables when the three are written.
    """
    facts = cut(analyzed(fetches, now), "facts")
    links = cut(links_of(facts), "links")
    pages = graph.page_sources(facts, links).withColumn("discovered", F.col("discovered") | F.col("linked")).drop("linked")
    broken = graph.broken_by_page(facts, links).withColumnRenamed("src_ord", "ord")
    pages = graph.inbound_counts(pages, links).join(broken, ["run", "ord"], "left").withColumn("broken_internal_links", F.coalesce("broken_internal_links", F.array().cast("array<string>")))
    pages = cut(pages, "pages")
    issues = cut(all_issues(pages, sitemap, probes, others, links), "issues")
    return pages, issues, scoring.scores(pages.withColumn("n_broken", F.size("broken_internal_links")), issues)
