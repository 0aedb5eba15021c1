"""Rules over one page: an array of conditional issues, exploded in order.

A page is a row with the columns named in PAGE; what a rule needs from other
operators (broken links, samples) comes as columns, too. One projection and one
generator: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.urls import host

#: Columns that the rules read; `complete` fills those that a table lacks with the values of a page without the feature.
PAGE = {
    "outcome": "'ok'", "error_message": "cast(null as string)", "status": "200", "redirect_count": "0", "in_sitemap": "false", "noindex": "false", "robots": "cast(null as string)",
    "title": "cast(null as string)", "title_length": "0", "title_px": "cast(null as int)", "canonical": "cast(null as string)", "site_host": "cast(null as string)",
    "meta_description": "cast(null as string)", "meta_description_length": "0", "meta_description_px": "cast(null as int)", "h1_count": "0",
    "broken_internal_links": "cast(array() as array<string>)", "images_total": "0", "images_missing_alt": "0",
    "open_graph": "cast(null as struct<title:string,description:string,image:string>)", "twitter": "cast(null as struct<card:string,title:string,description:string,image:string>)",
    "lang": "cast(null as string)", "has_favicon": "false", "word_count": "0", "page_type": "'generic'", "structured_types": "cast(array() as array<string>)",
    "headings": "cast(array() as array<struct<level:int,text:string>>)", "anchor_empty": "0", "anchor_generic": "0",
    "ambiguous": "cast(array() as array<struct<text:string,n:int,destinations:array<string>>>)", "anchor_empty_samples": "cast(array() as array<string>)", "anchor_generic_samples": "cast(array() as array<string>)",
    "repeated_samples": "cast(array() as array<struct<text:string,occurrences:bigint>>)", "mixed_content_samples": "cast(array() as array<string>)", "repeated_blocks": "0", "charset": "cast(null as string)", "has_doctype": "false",
    "mixed_content_count": "0", "compression": "cast(null as string)", "html_size_bytes": "0", "x_powered_by": "cast(null as string)",
    "alternate_links": "cast(array() as array<struct<hreflang:string,href:string>>)", "final_url": "url",
}


def complete(pages: DataFrame) -> DataFrame:
    return pages.withColumns({c: F.expr(v) for c, v in PAGE.items() if c not in pages.columns})


def empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def text(*parts) -> Column:
    """Literals and columns as one text."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def json(**fields) -> Column:
    """An object as JSON text, with its empty fields."""
    return F.to_json(F.struct(*(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def issue(when: Column, kind: str, severity, message, value: Column | None = None) -> Column:
    """An issue where the condition holds. value: as text what the message is about, where it is not a value of the page (VALUES)."""
    value = F.lit(None).cast("string") if value is None else value
    made = F.struct(F.lit(kind).alias("issue_type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), value.alias("value"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def some(issues: Column) -> Column:
    return F.filter(issues, lambda x: x.isNotNull())


def bound(value: Column, f) -> Column:
    """f of a value that is computed once; an expression that a lambda names is computed for each of its elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def heading_repeats() -> Column:
    """Texts repeated two or three times, in order of their first place. Headings are sorted by text once, so that equal ones stand side by side."""
    norm = lambda x: F.lower(F.trim(F.regexp_replace(x["text"], r"\s+", " ")))
    by_text = F.array_sort(F.transform("headings", lambda x, i: F.struct(norm(x).alias("norm"), i.alias("i"), x["level"].alias("level"), x["text"].alias("text"))))

    def groups(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["norm"] == x["norm"], F.lit(False))
        steps = range(1, config.HEADING_REPEATS)
        n = lambda x, j: sum((same(x, j + k).cast("int") for k in steps), F.lit(1))
        first = lambda x, j: (x["norm"] != "") & ~same(x, j - 1) & same(x, j + 1) & ~same(x, j + config.HEADING_REPEATS)
        made = lambda x, j: F.struct(x["i"].alias("i"), x["norm"].alias("norm"), x["text"].alias("shown"), n(x, j).alias("n"), F.transform(F.slice(s, j + 1, n(x, j)), lambda y: y["level"]).alias("levels"))
        return F.array_sort(some(F.transform(s, lambda x, j: F.when(first(x, j), made(x, j)))))

    about = lambda g: json(text=g["norm"], occurrences=g["n"], levels=g["levels"])
    return F.transform(bound(by_text, groups), lambda g: issue(F.lit(True), "duplicate_heading_text", F.when(g["n"] >= 3, "medium").otherwise("low"), text('Heading text "', g["shown"], '" is repeated ', g["n"], " times on the page."), about(g)))


def heading_skips() -> Column:
    """Levels that are left out, one issue each."""
    h = F.col("headings")
    before = lambda i: F.get(h, i - 1)["level"]
    return some(F.transform(h, lambda x, i: issue((i > 0) & (x["level"] > before(i) + 1), "heading_hierarchy_skip", "low", text("Heading level skips from H", before(i), " to H", x["level"], ' ("', x["text"], '") without an intervening level.'), json(**{"from": before(i), "to": x["level"], "text": x["text"]}))))


def heading_issues() -> Column:
    """Repeated texts, level skips, and too many headings for the words."""
    n, words = F.size("headings"), F.col("word_count")
    dense = (n >= config.HEADING_LEAST) & (words >= config.HEADING_WORDS) & (n / F.greatest(words, F.lit(1)) >= config.HEADING_RATIO)
    many = some(F.array(issue(dense, "excessive_headings", "low", text("Page has ", n, " headings for ", words, " words of content, a notably high heading-to-content ratio."), json(headingCount=n, wordCount=words, ratio=F.round(n / F.greatest(words, F.lit(1)), 3)))))
    return F.concat(heading_repeats(), heading_skips(), many)


def hreflang_issues() -> Column:
    links = F.col("alternate_links")
    missing = F.size(F.filter(links, lambda x: empty(x["href"])))
    invalid = F.filter(links, lambda x: ~empty(x["hreflang"]) & ~x["hreflang"].rlike(config.HREFLANG))
    whole = F.filter(links, lambda x: ~empty(x["hreflang"]) & ~empty(x["href"]))
    langs = F.array_distinct(F.transform(whole, lambda x: F.lower(x["hreflang"])))
    hrefs = lambda lang: F.array_distinct(F.transform(F.filter(whole, lambda x: F.lower(x["hreflang"]) == lang), lambda x: x["href"]))
    several = F.filter(langs, lambda lang: F.size(hrefs(lang)) > 1)
    shown = F.array_join(F.transform(invalid, lambda x: F.concat(F.lit('"'), x["hreflang"], F.lit('"'))), ", ")
    return some(F.array(
        issue(missing > 0, "hreflang_missing_href", "medium", text(missing, " hreflang alternate link(s) are missing an href attribute."), json(hreflangs=F.transform(F.filter(links, lambda x: empty(x["href"])), lambda x: x["hreflang"]))),
        issue(F.size(invalid) > 0, "invalid_hreflang", "low", text(F.size(invalid), " hreflang value(s) don't look like valid language[-region] codes: ", shown, "."), json(invalidValues=F.transform(invalid, lambda x: x["hreflang"]))),
        issue(F.size(several) > 0, "hreflang_duplicate_language", "medium", text("The same hreflang value is declared more than once with different URLs: ", F.array_join(several, ", "), "."), F.to_json(F.map_from_entries(F.transform(several, lambda lang: F.struct(lang, hrefs(lang)))))),
    ))


def page_issues() -> Column:
    """All rules on a crawled page, in their order; a page that failed has one issue only."""
    c = F.col
    px = F.coalesce(c("title_px"), F.lit(0))
    least = F.coalesce(*(F.when(c("page_type") == k, v) for k, v in config.LEAST_WORDS.items()))
    own_host = F.coalesce(host("canonical") == F.lower("site_host"), F.lit(False))
    none = lambda s, *fields: F.lit(True) if not fields else empty(c(s)[fields[0]]) & none(s, *fields[1:])
    plain = F.coalesce(c("compression"), F.lit("none")).isin("", "identity", "none")
    failed = F.array(
        issue(c("outcome") == "network_error", "crawl_failure", "critical", text("Page could not be crawled: ", F.coalesce("error_message", F.lit("unknown network error")))),
        issue((c("outcome") != "network_error") & (c("status") >= 500), "server_error", "critical", text("Page returned a server error (HTTP ", c("status"), ").")),
        issue((c("outcome") != "network_error") & c("status").between(400, 499), "client_error", "high", text("Page returned a client error (HTTP ", c("status"), ").")),
    )
    basics = F.array(
        issue((c("redirect_count") > 0) & c("in_sitemap"), "sitemap_url_redirect", "high", text("Sitemap URL redirects (", c("redirect_count"), " hop(s)) to ", c("final_url"), ".")),
        issue(c("noindex") & c("in_sitemap"), "sitemap_url_noindex", "high", "URL is included in the sitemap but marked noindex."),
        issue(empty("title"), "missing_title", "high", "Page is missing a <title> tag."),
        issue(~empty("title") & (px > config.TITLE_MOST_PX), "title_pixel_width_high", "low", text("Estimated title width (~", px, f"px) may exceed typical desktop search result display width (~{config.TITLE_MOST_PX}px).")),
        issue(~empty("title") & (c("title_length") < config.TITLE_LEAST), "title_too_short", F.when(c("page_type").isin(*config.TITLE_MATTERS), "medium").otherwise("low"), "Page title is very short and may not provide enough context to search engines or users."),
        issue(empty("canonical"), "missing_canonical", "high", "Page is missing a canonical link tag."),
        issue(~empty("canonical") & host("canonical").isNotNull() & ~own_host, "canonical_external_domain", "high", text("Canonical URL points to an unexpected external domain: ", host("canonical"), ".")),
        issue(~empty("canonical") & host("canonical").isNull(), "canonical_external_domain", "high", text("Canonical URL is not a valid absolute URL: ", c("canonical"))),
        issue(empty("meta_description"), "missing_meta_description", "medium", "Page is missing a meta description."),
        issue(~empty("meta_description") & (c("meta_description_px") > config.DESCRIPTION_MOST_PX), "meta_description_pixel_width_high", "low", text("Estimated meta description width (~", c("meta_description_px"), f"px) may exceed typical desktop search result display width (~{config.DESCRIPTION_MOST_PX}px).")),
        issue(c("h1_count") == 0, "missing_h1", "medium", "Page has no H1 heading."),
        issue(c("h1_count") > 1, "multiple_h1", "medium", text("Page has ", c("h1_count"), " H1 headings.")),
        issue(F.size("broken_internal_links") > 0, "broken_internal_links", "medium", text("Page contains ", F.size("broken_internal_links"), " broken internal link(s).")),
        issue(c("images_missing_alt") > 0, "images_missing_alt", "low", text(c("images_missing_alt"), " of ", c("images_total"), " image(s) are missing alt attributes.")),
        issue(none("open_graph", "title", "description", "image"), "missing_open_graph", "low", "Page is missing Open Graph metadata."),
        issue(none("twitter", "card", "title", "description", "image"), "missing_twitter", "low", "Page is missing Twitter card metadata."),
        issue(empty("lang"), "missing_lang", "low", "Page is missing an html lang attribute."),
        issue(~c("has_favicon"), "missing_favicon", "low", "Page is missing a favicon link."),
        issue(c("word_count") < least, "low_word_count", "low", text("Low content for ", c("page_type"), " page (", c("word_count"), " words, expected at least ", least, ").")),
        issue((c("page_type") == "episode") & ~F.array_contains("structured_types", "PodcastEpisode"), "missing_podcast_episode_schema", "medium", "Episode page is missing PodcastEpisode structured data."),
    )
    anchors = F.concat(
        F.array(
            issue(c("anchor_empty") > 0, "empty_internal_anchor", "medium", text(c("anchor_empty"), " internal link(s) have no accessible text (no visible text, aria-label, title, or alt'd image).")),
            issue(c("anchor_generic") > 0, "generic_anchor_text", "low", text(c("anchor_generic"), ' link(s) use generic anchor text (e.g. "click here", "read more") instead of descriptive text.')),
        ),
        F.transform("ambiguous", lambda a: issue(F.lit(True), "ambiguous_repeated_anchor_text", "low", text('Anchor text "', a["text"], '" is reused for ', a["n"], " different internal destinations, which may confuse users and search engines about what each link leads to."), json(text=a["text"], destinations=a["destinations"]))),
    )
    rest = F.array(
        issue(c("repeated_blocks") > 0, "duplicate_visible_content", F.when(c("repeated_blocks") >= config.BLOCKS_MEDIUM, "medium").otherwise("low"), text("Page repeats ", c("repeated_blocks"), " visible text block(s) (e.g. paragraph, CTA, or description copy) more than once.")),
        issue(empty("charset"), "missing_charset", "low", "Page does not declare a character encoding."),
        issue(~c("has_doctype"), "missing_doctype", "low", "Page does not start with an HTML5 doctype declaration."),
        issue(c("mixed_content_count") > 0, "mixed_content", "high", text(c("mixed_content_count"), " resource(s) are loaded over plain HTTP on this HTTPS page.")),
        issue(plain & (c("html_size_bytes") >= config.COMPRESS_FROM), "html_response_uncompressed", "low", text("HTML response (", F.floor(c("html_size_bytes") / 1024 + 0.5), " KB) was served without compression (content-encoding: ", F.coalesce("compression", F.lit("none")), ").")),
        issue(~empty("x_powered_by"), "x_powered_by_exposed", "low", text('Server exposes an X-Powered-By header ("', c("x_powered_by"), '").')),
    )
    bad = F.coalesce((c("outcome") == "network_error") | (c("status") >= 400), F.lit(False))
    return F.when(bad, some(failed)).otherwise(F.concat(some(basics), heading_issues(), some(anchors), some(rest), hreflang_issues()))


#: What an issue is about, as text: a value of its page, or some as JSON.
VALUES = {
    "crawl_failure": "error_message", "server_error": "status", "client_error": "status", "sitemap_url_redirect": "final_url", "sitemap_url_noindex": "robots", "title_too_short": "title_length",
    "canonical_external_domain": "canonical", "multiple_h1": "h1_count", "images_missing_alt": "images_missing_alt", "low_word_count": "word_count", "x_powered_by_exposed": "x_powered_by",
    "title_pixel_width_high": {"pixelWidthEstimate": "title_px", "titleLength": "title_length"}, "meta_description_pixel_width_high": {"pixelWidthEstimate": "meta_description_px", "length": "meta_description_length"},
    "broken_internal_links": ["broken_internal_links"], "duplicate_visible_content": ["repeated_samples"], "mixed_content": ["mixed_content_samples"],
    "html_response_uncompressed": {"htmlSizeBytes": "html_size_bytes", "compressionEncoding": "compression"},
    "empty_internal_anchor": {"count": "anchor_empty", "hrefs": "anchor_empty_samples"}, "generic_anchor_text": {"count": "anchor_generic", "samples": "anchor_generic_samples"},
}


def recommended(issue_type="issue_type", message="message") -> Column:
    """What to do about an issue; by its type, and for canonical tags by what is wrong with them."""
    kind = F.col(issue_type) if isinstance(issue_type, str) else issue_type
    table = F.create_map(*(F.lit(x) for kv in config.RECOMMENDATIONS.items() for x in kv))
    invalid = (kind == "canonical_external_domain") & F.startswith(F.col(message), F.lit("Canonical URL is not"))
    return F.when(invalid, config.CANONICAL_INVALID).otherwise(F.try_element_at(table, kind))


def apply_page_rules(pages: DataFrame, key: list[str]) -> DataFrame:
    """key, rule_ord, issue_type, severity, message, value, recommendation: a row for each issue."""
    as_text = lambda v: F.col(v).cast("string") if isinstance(v, str) else F.to_json(v[0]) if isinstance(v, list) else json(**v)
    of_page = F.coalesce(*(F.when(F.col("i.issue_type") == k, as_text(v)) for k, v in VALUES.items()))
    d = complete(pages).select("*", F.posexplode(page_issues()).alias("rule_ord", "i"))
    d = d.select(*key, "rule_ord", "i.issue_type", "i.severity", "i.message", F.coalesce("i.value", of_page).alias("value"))
    return d.withColumn("recommendation", recommended())


def indexing_state(publication_state="publication_state") -> Column:
    """indexable, noindex_expected, noindex_review or noindex_unexpected."""
    c = F.col
    p = c(publication_state) if isinstance(publication_state, str) else publication_state
    out = F.when((c("outcome") != "ok") | ~c("noindex"), "indexable").when(c("in_sitemap"), "noindex_unexpected")
    kinds = sorted({*config.NOINDEX_ALLOWED, *config.NOINDEX_FORBIDDEN})
    out = out.when(~c("page_type").isin(*kinds), "noindex_expected")
    for k in kinds:
        out = out.when((c("page_type") == k) & p.isin(*config.NOINDEX_FORBIDDEN[k]), "noindex_unexpected").when((c("page_type") == k) & p.isin(*config.NOINDEX_ALLOWED[k]), "noindex_expected")
    return out.otherwise("noindex_review")


def indexing_issues(pages: DataFrame, key: list[str]) -> DataFrame:
    """Issues of noindex pages that the sitemap does not name."""
    state = indexing_state()
    out = F.when(F.col("in_sitemap"), None).when(state == "noindex_unexpected", issue(F.lit(True), "unexpected_noindex", "high", "Published episode page is marked noindex and may be excluded from search results.", F.col("publication_state")))
    out = out.when(state == "noindex_review", issue(F.lit(True), "noindex_requires_review", "low", "Page is noindex and its publication state could not be determined; worth a manual check.", F.col("publication_state")))
    return pages.select(*key, out.alias("i")).filter("i is not null").select(*key, "i.*").withColumn("recommendation", recommended())


def host_canonicalization(probes: DataFrame) -> DataFrame:
    """From probes (site_url, preferred_host, alternate_host, status, location_host): the verdict and, for a site that answers under both hosts, an issue."""
    c = F.col
    ok = c("status").between(300, 399) & (c("location_host") == c("preferred_host"))
    verdict = F.when(F.coalesce(ok, F.lit(False)), "ok").when(c("status").between(200, 299), "issue").otherwise("inconclusive")
    message = text("Both https://", c("preferred_host"), "/ and https://", c("alternate_host"), "/ serve independent 200 responses instead of the non-preferred host redirecting to the preferred one.")
    todo = text("Configure ", c("alternate_host"), " to redirect (301) to the preferred host (", c("preferred_host"), ") to avoid duplicate-content signals.")
    value = json(preferredHost="preferred_host", alternateHost="alternate_host", alternateStatus="status")
    bad = lambda x: F.when(verdict == "issue", x)
    rest = [c for c in probes.columns if c not in ("site_url", "preferred_host", "alternate_host", "status", "location_host")]
    return probes.select(
        *rest, "site_url", "preferred_host", c("status").alias("www_redirect_status"), verdict.alias("verdict"), bad("host_canonicalization_issue").alias("issue_type"), bad("high").alias("severity"),
        bad(message).alias("message"), bad(value).alias("value"), bad(todo).alias("recommendation"),
    )
