"""Queries over tables of cases: every rule, comparison and view on rows made by plain arithmetic, and the same in DuckDB's SQL.

Rows come from the driver's tables by formulas that both engines read alike
(k is a table's key), so that each rule meets rows it fires on and rows it
does not. What a rule says is stated a second time in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config
from .functions import html
from .operators import history, rules, samples, scoring
from .plans import dashboard, views
from .queries import FC, FI, LATEST, RUNS, SUMMARY
from .sources import adapters, discovery
from .streaming import control

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- every page rule ----------------------------------------------------------------

PAGE = {
    "url": "concat('https://site.example/', k)", "final_url": "concat('https://site.example/', k)", "site_host": "'Site.example'",
    "outcome": "case when k % 41 = 0 then 'network_error' when k % 23 = 0 then 'http_error' else 'ok' end", "error_message": "case when k % 82 = 0 then 'timeout' end",
    "status": "case when k % 41 = 0 then null when k % 46 = 0 then 503 when k % 23 = 0 then 404 else 200 end", "redirect_count": "case when k % 7 = 0 then 2 else 0 end",
    "in_sitemap": "k % 2 = 0", "noindex": "k % 5 = 0", "robots": "case when k % 5 = 0 then 'noindex' end",
    "title": "case when k % 6 = 0 then null when k % 6 = 1 then '' when k % 6 = 2 then 'short' else concat('A title of page number ', k) end",
    "title_length": "case when k % 6 < 2 then 0 when k % 6 = 2 then 5 else 25 end", "title_px": "500 + k % 180",
    "canonical": "case k % 4 when 0 then null when 1 then 'https://site.example/p' when 2 then 'https://Other.example/x' else 'relative/path' end",
    "meta_description": "case k % 3 when 0 then null when 1 then '' else 'd' end", "meta_description_length": "k % 170", "meta_description_px": "900 + k % 100", "h1_count": "k % 4",
    "images_total": "7", "images_missing_alt": "k % 3", "lang": "case k % 5 when 0 then null when 1 then '' else 'en' end", "has_favicon": "k % 3 = 1", "word_count": "k % 700",
    "page_type": "case k % 6 when 0 then 'homepage' when 1 then 'episode' when 2 then 'episodes_index' when 3 then 'service' when 4 then 'booking' else 'generic' end",
    "anchor_empty": "k % 3", "anchor_generic": "k % 4", "repeated_blocks": "k % 5", "charset": "case when k % 2 = 0 then 'utf-8' end", "has_doctype": "k % 3 = 0", "mixed_content_count": "k % 2",
    "compression": "case k % 4 when 0 then null when 1 then 'identity' when 2 then 'gzip' else '' end", "html_size_bytes": "4000 + (k * 13) % 3000", "x_powered_by": "case k % 3 when 0 then null when 1 then '' else 'PHP' end",
    "publication_state": "case k % 4 when 0 then 'published' when 1 then 'scheduled' when 2 then 'draft' else 'unknown' end",
}
HEADINGS = [[], [(1, "A"), (2, "a "), (3, "A"), (3, "b")], [(1, "a"), (3, "b"), (2, "c"), (6, "d")], [(2, f"h{i}") for i in range(8)], [(2, " x  y "), (2, "X Y")], [(1, "r")] * 4]
LINKS = [[], [("en", ""), ("e!", "x"), ("De", "a"), ("de", "b"), ("x-default", "c")], [("en", "u"), ("en", "u"), ("", "z")], [("fr", None), ("pt-br", "q"), ("bad code", "r")]]


def spark_lists(lists: list, fields: str) -> F.Column:
    """The list of row k, by turns."""
    schema = f"array<struct<{fields}>>"
    whole = F.lit(None).cast(schema)
    for k, rows in enumerate(lists):
        made = F.array(*(F.struct(*(F.lit(v) for v in row)) for row in rows)).cast(schema) if rows else F.expr(f"cast(array() as {schema})")
        whole = F.when(F.expr(f"k % {len(lists)} = {k}"), made).otherwise(whole)
    return whole


def sql_lists(lists: list) -> str:
    """Rows (turn, i, x, y) of the lists."""
    quoted = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "values " + ", ".join(f"({k}, {i}, {quoted(x)}, {quoted(y)})" for k, rows in enumerate(lists) for i, (x, y) in enumerate(rows))


def case_pages(spark, sf_dir) -> DataFrame:
    d = adapters.spread(adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k")), "k")
    d = d.withColumns({c: F.expr(e) for c, e in PAGE.items()})
    graph = "struct<title:string,description:string,image:string>"
    card = "struct<card:string,title:string,description:string,image:string>"
    numbers = lambda n: F.when(F.expr(f"{n} > 0"), F.sequence(F.lit(1), F.expr(n))).otherwise(F.expr("cast(array() as array<int>)"))
    return d.withColumns({
        "open_graph": F.expr(f"case k % 3 when 0 then cast(null as {graph}) when 1 then cast(named_struct('title', '', 'description', null, 'image', null) as {graph}) else cast(named_struct('title', 't', 'description', null, 'image', null) as {graph}) end"),
        "twitter": F.expr(f"case when k % 4 < 2 then cast(null as {card}) else cast(named_struct('card', 'summary', 'title', null, 'description', null, 'image', null) as {card}) end"),
        "structured_types": F.expr("case when k % 2 = 0 then array('Thing', 'PodcastEpisode') else array('Thing') end"),
        "broken_internal_links": F.transform(numbers("k % 3"), lambda i: F.concat(F.lit("b"), i.cast("string"))),
        "ambiguous": F.transform(numbers("k % 3"), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("text"), (i + 2).alias("n"), F.array(F.lit("x")).alias("destinations"))),
        "headings": spark_lists(HEADINGS, "level:int,text:string"), "alternate_links": spark_lists(LINKS, "hreflang:string,href:string"),
    })


CASES = f"p as (select k, {', '.join(f'{e} as {c}' for c, e in PAGE.items())} from (select cast(p_partkey as integer) as k from part))"
FAILED = "(outcome = 'network_error' or coalesce(status >= 400, false))"
LEAST = "case page_type " + " ".join(f"when '{k}' then {v}" for k, v in config.LEAST_WORDS.items()) + " end"
CANONICAL_HOST = "lower(regexp_extract(canonical, '^https?://([^/?#]+)', 1))"
RULES = [
    ("sitemap_url_redirect", "'high'", "redirect_count > 0 and in_sitemap", "concat('Sitemap URL redirects (', redirect_count, ' hop(s)) to ', final_url, '.')", "final_url"),
    ("sitemap_url_noindex", "'high'", "noindex and in_sitemap", "'URL is included in the sitemap but marked noindex.'", "robots"),
    ("missing_title", "'high'", "coalesce(title, '') = ''", "'Page is missing a <title> tag.'", None),
    ("title_pixel_width_high", "'low'", "coalesce(title, '') <> '' and title_px > 600", "concat('Estimated title width (~', title_px, 'px) may exceed typical desktop search result display width (~600px).')", """concat('{"pixelWidthEstimate":', title_px, ',"titleLength":', title_length, '}')"""),
    ("title_too_short", "case when page_type in ('homepage', 'episode', 'episodes_index') then 'medium' else 'low' end", "coalesce(title, '') <> '' and title_length < 20", "'Page title is very short and may not provide enough context to search engines or users.'", "title_length"),
    ("missing_canonical", "'high'", "canonical is null", "'Page is missing a canonical link tag.'", None),
    ("canonical_external_domain", "'high'", f"{CANONICAL_HOST} not in ('', 'site.example')", f"concat('Canonical URL points to an unexpected external domain: ', {CANONICAL_HOST}, '.')", "canonical"),
    ("canonical_external_domain", "'high'", f"{CANONICAL_HOST} = ''", "concat('Canonical URL is not a valid absolute URL: ', canonical)", "canonical"),
    ("missing_meta_description", "'medium'", "coalesce(meta_description, '') = ''", "'Page is missing a meta description.'", None),
    ("meta_description_pixel_width_high", "'low'", "meta_description <> '' and meta_description_px > 950", "concat('Estimated meta description width (~', meta_description_px, 'px) may exceed typical desktop search result display width (~950px).')", """concat('{"pixelWidthEstimate":', meta_description_px, ',"length":', meta_description_length, '}')"""),
    ("missing_h1", "'medium'", "h1_count = 0", "'Page has no H1 heading.'", None), ("multiple_h1", "'medium'", "h1_count > 1", "concat('Page has ', h1_count, ' H1 headings.')", "h1_count"),
    ("broken_internal_links", "'medium'", "k % 3 > 0", "concat('Page contains ', k % 3, ' broken internal link(s).')", """case k % 3 when 1 then '["b1"]' else '["b1","b2"]' end"""),
    ("images_missing_alt", "'low'", "images_missing_alt > 0", "concat(images_missing_alt, ' of ', images_total, ' image(s) are missing alt attributes.')", "images_missing_alt"),
    ("missing_open_graph", "'low'", "k % 3 < 2", "'Page is missing Open Graph metadata.'", None), ("missing_twitter", "'low'", "k % 4 < 2", "'Page is missing Twitter card metadata.'", None),
    ("missing_lang", "'low'", "coalesce(lang, '') = ''", "'Page is missing an html lang attribute.'", None), ("missing_favicon", "'low'", "not has_favicon", "'Page is missing a favicon link.'", None),
    ("low_word_count", "'low'", f"word_count < {LEAST}", f"concat('Low content for ', page_type, ' page (', word_count, ' words, expected at least ', {LEAST}, ').')", "word_count"),
    ("missing_podcast_episode_schema", "'medium'", "page_type = 'episode' and k % 2 = 1", "'Episode page is missing PodcastEpisode structured data.'", None),
    ("empty_internal_anchor", "'medium'", "anchor_empty > 0", "concat(anchor_empty, ' internal link(s) have no accessible text (no visible text, aria-label, title, or alt''d image).')", """concat('{"count":', anchor_empty, ',"hrefs":[]}')"""),
    ("generic_anchor_text", "'low'", "anchor_generic > 0", """concat(anchor_generic, ' link(s) use generic anchor text (e.g. "click here", "read more") instead of descriptive text.')""", """concat('{"count":', anchor_generic, ',"samples":[]}')"""),
    ("duplicate_visible_content", "case when repeated_blocks >= 3 then 'medium' else 'low' end", "repeated_blocks > 0", "concat('Page repeats ', repeated_blocks, ' visible text block(s) (e.g. paragraph, CTA, or description copy) more than once.')", "'[]'"),
    ("missing_charset", "'low'", "charset is null", "'Page does not declare a character encoding.'", None), ("missing_doctype", "'low'", "not has_doctype", "'Page does not start with an HTML5 doctype declaration.'", None),
    ("mixed_content", "'high'", "mixed_content_count > 0", "concat(mixed_content_count, ' resource(s) are loaded over plain HTTP on this HTTPS page.')", "'[]'"),
    ("html_response_uncompressed", "'low'", "coalesce(compression, '') in ('', 'identity') and html_size_bytes >= 5120", "concat('HTML response (', cast(floor(html_size_bytes / 1024.0 + 0.5) as integer), ' KB) was served without compression (content-encoding: ', coalesce(compression, 'none'), ').')", """concat('{"htmlSizeBytes":', html_size_bytes, ',"compressionEncoding":', coalesce('"' || compression || '"', 'null'), '}')"""),
    ("x_powered_by_exposed", "'low'", "coalesce(x_powered_by, '') <> ''", """concat('Server exposes an X-Powered-By header ("', x_powered_by, '").')""", "x_powered_by"),
]
ONE = lambda kind, severity, when, message, value: f"select k, '{kind}' as issue_type, {severity} as severity, {message} as message, cast({value or 'null'} as varchar) as value from p where {when}"
RULES_SQL = " union all ".join([
    ONE("crawl_failure", "'critical'", "outcome = 'network_error'", "concat('Page could not be crawled: ', coalesce(error_message, 'unknown network error'))", "error_message"),
    ONE("server_error", "'critical'", "outcome <> 'network_error' and status >= 500", "concat('Page returned a server error (HTTP ', status, ').')", "status"),
    ONE("client_error", "'high'", "outcome <> 'network_error' and status between 400 and 499", "concat('Page returned a client error (HTTP ', status, ').')", "status"),
    *(ONE(k, s, f"not {FAILED} and {w}", m, v) for k, s, w, m, v in RULES),
])


@query(f"with {CASES} {RULES_SQL}")
def rules_every_page_rule(spark, sf_dir):
    """Issues of all rules over scalar facts, with message and value."""
    own = ["crawl_failure", "server_error", "client_error", *(r[0] for r in RULES)]
    return rules.apply_page_rules(case_pages(spark, sf_dir), ["k"]).filter(F.col("issue_type").isin(*own)).select("k", "issue_type", "severity", "message", "value")


HEADED = rf"""{CASES}, v(turn, i, level, text) as ({sql_lists(HEADINGS)}), h as (select k, word_count, i, level, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as norm from p join v on turn = k % {len(HEADINGS)} where not {FAILED})"""


@query(rf"""with {HEADED}, g as (select k, norm, count(*) as n, arg_min(text, i) as shown from h where norm <> '' group by all having count(*) between 2 and 3),
    s as (select k, i, level, text, lag(level) over (partition by k order by i) as before from h), d as (select k, word_count, count(*) as n from h group by all having count(*) >= 8 and word_count >= 30 and count(*) / word_count >= 0.12)
    select k, 'duplicate_heading_text' as issue_type, case when n >= 3 then 'medium' else 'low' end as severity, 'Heading text "' || shown || '" is repeated ' || n || ' times on the page.' as message from g
    union all select k, 'heading_hierarchy_skip', 'low', 'Heading level skips from H' || before || ' to H' || level || ' ("' || text || '") without an intervening level.' from s where level > before + 1
    union all select k, 'excessive_headings', 'low', 'Page has ' || n || ' headings for ' || word_count || ' words of content, a notably high heading-to-content ratio.' from d""")
def rules_headings(spark, sf_dir):
    d = rules.apply_page_rules(case_pages(spark, sf_dir), ["k"])
    return d.filter(F.col("issue_type").isin("duplicate_heading_text", "heading_hierarchy_skip", "excessive_headings")).select("k", "issue_type", "severity", "message")


@query(rf"""with {CASES}, v(turn, i, lang, href) as ({sql_lists(LINKS)}), l as (select k, i, v.lang, href from p join v on turn = k % {len(LINKS)} where not {FAILED}),
    m as (select k, count(*) as n from l where coalesce(href, '') = '' group by k),
    b as (select k, count(*) as n, string_agg('"' || lang || '"', ', ' order by i) as shown from l where lang <> '' and not regexp_matches(lang, '{config.HREFLANG}') group by k),
    d0 as (select k, lower(lang) as lang, min(i) as i from l where lang <> '' and href <> '' group by k, lower(lang) having count(distinct href) > 1), d as (select k, string_agg(lang, ', ' order by i) as shown from d0 group by k)
    select k, 'hreflang_missing_href' as issue_type, 'medium' as severity, n || ' hreflang alternate link(s) are missing an href attribute.' as message from m
    union all select k, 'invalid_hreflang', 'low', n || ' hreflang value(s) don''t look like valid language[-region] codes: ' || shown || '.' from b
    union all select k, 'hreflang_duplicate_language', 'medium', 'The same hreflang value is declared more than once with different URLs: ' || shown || '.' from d""")
def rules_hreflang(spark, sf_dir):
    d = rules.apply_page_rules(case_pages(spark, sf_dir), ["k"])
    return d.filter(F.col("issue_type").isin("hreflang_missing_href", "invalid_hreflang", "hreflang_duplicate_language")).select("k", "issue_type", "severity", "message")


@query(f"""with {CASES} select k, 'ambiguous_repeated_anchor_text' as issue_type, 'Anchor text "t' || i || '" is reused for ' || (i + 2) || ' different internal destinations, which may confuse users and search engines about what each link leads to.' as message,
    '{{"text":"t' || i || '","destinations":["x"]}}' as value from p, range(1, 3) as r(i) where not {FAILED} and i <= k % 3""")
def rules_ambiguous_anchors(spark, sf_dir):
    d = rules.apply_page_rules(case_pages(spark, sf_dir), ["k"])
    return d.filter("issue_type = 'ambiguous_repeated_anchor_text'").select("k", "issue_type", "message", "value")


RECOMMENDED = "case issue_type " + " ".join("when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in config.RECOMMENDATIONS.items()) + " end"


@query(f"with {CASES}, i as ({RULES_SQL}) select issue_type, case when message like 'Canonical URL is not%' then '{config.CANONICAL_INVALID}' else {RECOMMENDED} end as recommendation, count(*) as n from i group by all")
def rules_recommendations(spark, sf_dir):
    own = ["crawl_failure", "server_error", "client_error", *(r[0] for r in RULES)]
    return rules.apply_page_rules(case_pages(spark, sf_dir), ["k"]).filter(F.col("issue_type").isin(*own)).groupBy("issue_type", "recommendation").agg(F.count("*").alias("n"))


STATE = """case when outcome <> 'ok' or not noindex then 'indexable' when in_sitemap then 'noindex_unexpected' when page_type <> 'episode' then 'noindex_expected'
      when publication_state = 'published' then 'noindex_unexpected' when publication_state in ('scheduled', 'draft') then 'noindex_expected' else 'noindex_review' end"""


@query(f"with {CASES} select k, {STATE} as state from p")
def indexing_states_all(spark, sf_dir):
    return case_pages(spark, sf_dir).select("k", rules.indexing_state().alias("state"))


@query(f"""with {CASES}, s as (select *, {STATE} as state from p where not in_sitemap) select k, 'unexpected_noindex' as issue_type, 'high' as severity, publication_state as value from s where state = 'noindex_unexpected'
    union all select k, 'noindex_requires_review', 'low', publication_state from s where state = 'noindex_review'""")
def indexing_issues(spark, sf_dir):
    return rules.indexing_issues(case_pages(spark, sf_dir), ["k"]).select("k", "issue_type", "severity", "value")


@query("""with p as (select s_suppkey as k, case s_suppkey % 5 when 0 then 200 when 1 then 301 when 2 then 302 when 3 then 404 end as status, case s_suppkey % 3 when 0 then 'a.example' when 1 then 'www.a.example' end as loc from supplier)
    select k, case when status between 300 and 399 and loc = 'a.example' then 'ok' when status between 200 and 299 then 'issue' else 'inconclusive' end as verdict, status,
      case when status = 200 then 'Configure www.a.example to redirect (301) to the preferred host (a.example) to avoid duplicate-content signals.' end as recommendation,
      case when status = 200 then '{"preferredHost":"a.example","alternateHost":"www.a.example","alternateStatus":200}' end as value from p""")
def host_probe(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).withColumns({
        "site_url": F.lit("https://a.example"), "preferred_host": F.lit("a.example"), "alternate_host": F.lit("www.a.example"),
        "status": F.expr("case k % 5 when 0 then 200 when 1 then 301 when 2 then 302 when 3 then 404 end"), "location_host": F.expr("case k % 3 when 0 then 'a.example' when 1 then 'www.a.example' end"),
    })
    return rules.host_canonicalization(d).select("k", "verdict", F.col("www_redirect_status").alias("status"), "recommendation", "value")


# --- anchors and parsed markup --------------------------------------------------------

ANCHOR_TEXTS = ["Read more.", "our team", "Our Team", "x", "", "Contact", "learn more ! ", "Shop"]


def case_anchors(spark, sf_dir) -> DataFrame:
    """Pages (customers) with an anchor for each order: its text by turns, its target by the order's key."""
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    text = F.element_at(F.array(*map(F.lit, ANCHOR_TEXTS)), (F.col("o") % len(ANCHOR_TEXTS) + 1).cast("int"))
    one = F.struct("o", F.concat(F.lit("/t"), (F.col("o") % 31).cast("string")).alias("href"), text.alias("text"), (F.col("o") % 9 != 0).alias("is_internal"))
    rows = o.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return rows.select("k", F.transform("a", lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"), x["is_internal"].alias("is_internal"))).alias("anchors"))


ANCHORS = """a as (select o_custkey as k, o_orderkey as o, '/t' || (o_orderkey % 31) as href, ([{}])[o_orderkey % {} + 1] as text, o_orderkey % 9 <> 0 as inside from orders),
    b as (select *, length(trim(text)) < 2 as empty, regexp_replace(lower(text), '[.!?\\s]+$', '') in ({}) as generic from a)""".format(
    ", ".join(f"'{x}'" for x in ANCHOR_TEXTS), len(ANCHOR_TEXTS), ", ".join(f"'{x}'" for x in config.GENERIC_ANCHORS)
)


@query(f"with {ANCHORS}, g as (select k, lower(text) as text, href, min(o) as o from b where inside and not empty and not generic group by all), t as (select k, text, count(*) as n, min(o) as o from g group by all having count(*) >= 3), r as (select *, row_number() over (partition by k order by o) as rank from t) select k, text, least(n, 5) as destinations, rank from r where rank <= 5")
def anchors_ambiguous_cases(spark, sf_dir):
    d = samples.ambiguous_anchors(case_anchors(spark, sf_dir), ["k"])
    return d.select("k", "text", F.size("destinations").cast("bigint").alias("destinations"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""with {ANCHORS} select k, count(*) filter (inside) as internal, count(*) filter (not inside) as external, count(distinct href) filter (inside) as unique_internal, count(distinct href) filter (not inside) as unique_external,
    count(*) filter (inside and empty) as empty_internal, count(*) filter (not empty and generic) as generic, coalesce(array_to_string(list_slice(list(href order by o) filter (inside and empty), 1, 5), ','), '') as empty_samples from b group by k""")
def anchors_counted(spark, sf_dir):
    d = case_anchors(spark, sf_dir).select("k", samples.anchor_counts("anchors").alias("m"))
    n = [F.col(f"m.{c}").cast("bigint").alias(c) for c in ("internal", "external", "unique_internal", "unique_external", "empty_internal", "generic")]
    return d.select("k", *n, F.array_join("m.empty_samples", ",").alias("empty_samples"))


MARKUP = """concat('<!doctype html><html lang="', case k % 3 when 0 then 'en' when 1 then ' de ' else '' end, '"><head><title> T ', k, ' </title>', case when k % 2 = 0 then '<meta NAME="Description" content=" d">' else '' end,
    '<meta property="og:title" content="og', k % 5, '"><meta name="twitter:card" content="c"><link rel="canonical" href="/c/', k % 7, '/?utm_source=x">', case when k % 4 = 0 then '<link rel="shortcut icon" href="/f.ico">' else '' end,
    '<meta name="viewport" content="w"><meta http-equiv="content-type" content="text/html; charset = utf-8"><meta name=robots content="', case when k % 5 = 0 then 'NOINDEX, follow' else 'index' end, '"><link rel="alternate" hreflang="de" href="/de">',
    '<script type="application/ld+json">{"@graph":[{"@type":["PodcastEpisode","Thing"]},{"@type":"Person"}]}</script></head><body><nav><p>skip</p></nav><h1>One</h1><h2> </h2>', case when k % 3 = 0 then '<h3>T  wo</h3>' else '' end,
    '<p>a b</p><a href="/in"><img src="http://x.com/i.png" alt="pic"></a><a href="https://out.example/z">o</a>', case when k % 2 = 1 then '<img src="/a.png"><img alt=" ">' else '' end, '</body></html>')"""


@query("""with k as (select c_custkey as k from customer)
    select k, concat('T ', k) as title, case when k % 2 = 0 then 'd' end as meta_description, concat('https://h.example/c/', k % 7) as canonical, case k % 3 when 0 then 'en' when 1 then 'de' end as lang, 'utf-8' as charset,
      k % 5 = 0 as noindex, true as has_viewport, k % 4 = 0 as has_favicon, true as has_doctype, case when k % 3 = 0 then '1:One,3:T wo' else '1:One' end as headings, 'One' as h1, case when k % 2 = 1 then 3 else 1 end as images_total,
      case when k % 2 = 1 then 2 else 0 end as images_missing_alt, 'PodcastEpisode,Thing,Person' as structured_types, 'http://x.com/i.png' as mixed_content, concat('og', k % 5) as og_title, 'c' as twitter_card, 'de=/de' as alternates, 'https://h.example/in' as internal_links, 'https://out.example/z' as external_links from k""")
def markup_facts(spark, sf_dir):
    """Everything that the parser takes from markup whose parts vary with the key."""
    d = adapters.spread(adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k").withColumns({"html": F.expr(MARKUP), "final_url": F.concat(F.lit("https://h.example/"), F.col("k").cast("string"))})
    d = html.with_facts(d)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return d.select(
        "k", "title", "meta_description", "canonical", F.nullif("lang", F.lit("")).alias("lang"), "charset", "noindex", "has_viewport", "has_favicon", "has_doctype",
        joined("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["text"])).alias("headings"), F.array_join("h1", ",").alias("h1"), "images_total", "images_missing_alt",
        F.array_join("structured_types", ",").alias("structured_types"), F.array_join("mixed_content", ",").alias("mixed_content"), F.col("open_graph.title").alias("og_title"), F.col("twitter.card").alias("twitter_card"),
        joined("alternate_links", lambda x: F.concat_ws("=", x["hreflang"], x["href"])).alias("alternates"), F.array_join("internal_links", ",").alias("internal_links"), F.array_join("external_links", ",").alias("external_links"),
    )


# --- crawl comparison -----------------------------------------------------------------

PAIRS = {
    "status": "case when {k} % 9 = 0 then null when {k} % 7 = 0 then 404 else 200 end", "final_url": "concat('https://h.example/', {k} % 3, case when {k} % 2 = 0 then '/' else '' end)", "title": "case {k} % 4 when 0 then null when 1 then ' T  x' when 2 then 'T x' else 'other' end",
    "canonical": "case {k} % 3 when 0 then null when 1 then 'https://h.example/a' else 'https://h.example/a/' end", "h1_count": "{k} % 3", "word_count": "({k} * 37) % 900", "noindex": "{k} % 5 = 0", "is_indexable": "{k} % 6 = 0",
    "indexing_state": "case when {k} % 4 = 0 then 'noindex_review' else 'indexable' end", "publication_state": "case {k} % 3 when 0 then 'published' when 1 then 'scheduled' else 'unknown' end", "page_type": "case when {k} % 8 = 0 then 'episode' else 'generic' end",
    "in_sitemap": "{k} % 3 = 0", "discovered": "{k} % 4 = 0", "inbound": "{k} % 13", "html_size_bytes": "cast({k} as bigint) * 7919 % 600000", "response_time_ms": "{k} * 131 % 5000", "internal_link_count": "{k} % 60", "external_link_count": "{k} * 7 % 80",
}
NOW_K, BEFORE_K = "k", "(k * 11 + 3)"


def case_pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"))
    one = lambda at, n: d.filter(f"k % {n} <> 0").withColumns({c: F.expr(e.format(k=at)) for c, e in PAIRS.items()}).selectExpr("'r' as pair", "k as ord", "concat('u', k) as url", "concat('u', k) as url_key", *PAIRS)
    return one(NOW_K, 10), one(BEFORE_K, 12)


SHARE = "(abs(b - a) >= {least} and abs(b - a) >= {share} * a)"


@query(f"""with c as (select cast(p_partkey as integer) as k from part), n as (select k, {", ".join(f"{e.format(k=NOW_K)} as {c}" for c, e in PAIRS.items())} from c where k % 10 <> 0), o as (select k, {", ".join(f"{e.format(k=BEFORE_K)} as {c}" for c, e in PAIRS.items())} from c where k % 12 <> 0),
    j as (select coalesce(n.k, o.k) as k, n.k as nk, o.k as ok, n, o from n full join o on n.k = o.k)
    select k, 'page_new' as event_type, null as field_name from j where ok is null union all select k, 'page_removed', null from j where nk is null
    {" ".join(f"union all select k, '{kind}', '{history.STORED.get(f, f)}' from j where nk is not null and ok is not null and n.{f} is distinct from o.{f}" for f, kind in [("status", "http_status_changed"), ("h1_count", "field_changed"), ("noindex", "field_changed"), ("is_indexable", "indexability_changed"), ("indexing_state", "indexing_state_changed"), ("publication_state", "publication_state_changed"), ("page_type", "field_changed")])}
    union all select k, 'page_added_to_sitemap', 'source_sitemap' from j where n.in_sitemap and not o.in_sitemap union all select k, 'page_removed_from_sitemap', 'source_sitemap' from j where o.in_sitemap and not n.in_sitemap
    union all select k, 'page_became_discovered', 'source_discovered' from j where n.discovered and not o.discovered union all select k, 'page_no_longer_discovered', 'source_discovered' from j where o.discovered and not n.discovered""")
def diff_page_flags(spark, sf_dir):
    """Events of fields that either differ or do not."""
    plain = ["status", "h1_count", "noindex", "is_indexable", "indexing_state", "publication_state", "page_type", "in_sitemap", "discovered"]
    names = [history.STORED.get(f, f) for f in plain]
    now, before = case_pair(spark, sf_dir)
    e = history.compare_pages(now, before).filter(F.col("event_type").isin("page_new", "page_removed") | F.col("field_name").isin(*names))
    return e.select(F.expr("cast(substring(url, 2) as int)").alias("k"), "event_type", "field_name")


@query(f"""with r as (select c_custkey as pair, case when c_custkey % 3 <> 0 then c_custkey + 1000 end as previous_id from customer),
    i as (select o_custkey as pair, o_orderkey % 7 as key, case when o_orderkey % 2 = 0 then 'high' else 'low' end as severity, o_orderkey as ord, o_orderkey % 3 as side from orders),
    n as (select pair, key, arg_max(severity, ord) as severity from i where side < 2 group by all), o as (select pair, key, arg_max(severity, ord) as severity from i where side > 0 group by all),
    j as (select coalesce(n.pair, o.pair) as pair, n.severity as a, o.severity as b from n full join o on n.pair = o.pair and n.key = o.key)
    select r.pair, previous_id is null as baseline, previous_id, count(*) filter (previous_id is not null and a is not null and b is null) as new_issues, count(*) filter (previous_id is not null and a is null and b is not null) as resolved_issues,
      count(*) filter (previous_id is not null and a is not null and b is not null) as ongoing_issues from r left join j on j.pair = r.pair group by all""")
def compare_crawls(spark, sf_dir):
    """Comparisons with and without a previous crawl."""
    pairs = adapters.table(spark, sf_dir, "customer").selectExpr("c_custkey as pair", "case when c_custkey % 3 <> 0 then c_custkey + 1000 end as previous_id")
    i = adapters.table(spark, sf_dir, "orders").selectExpr("o_custkey as pair", "cast(o_orderkey % 7 as string) as issue_key", "concat('u', o_orderkey % 7) as url", "case when o_orderkey % 2 = 0 then 'high' else 'low' end as severity", "o_orderkey as ord", "o_orderkey % 3 as side")
    pages = i.selectExpr("pair", "url as url_key", "url", "ord").limit(0)
    out, _ = history.compare_crawls(pairs, (i.filter("side < 2"), i.filter("side > 0")), (pages, pages))
    return out.select("pair", "baseline", "previous_id", "new_issues", "resolved_issues", "ongoing_issues")


# --- dashboard ---------------------------------------------------------------------------

FINISHED = "case when id % 4 = 0 then null else started_at + interval 6 hours end"


@query(f"""with {RUNS}, {LATEST}, {FI}, {FC}, r as (select *, {FINISHED} as finished_at from lr), i as (select run_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high from fi group by run_id),
    s as (select run_id, {SUMMARY} from fc group by run_id), u as (select l_orderkey as run_id, count(*) filter (l_partkey % 11 = 0) as unexpected from lineitem group by l_orderkey),
    d as (select r.*, coalesce(i.critical, 0) as critical, coalesce(i.high, 0) as high, coalesce(u.unexpected, 0) as unexpected, coalesce(s.new_issues, 0) as new_issues, coalesce(s.changed_pages, 0) as changed_pages,
        greatest(0, cast(floor(epoch(timestamp '1998-08-02 12:00:00' - coalesce(finished_at, started_at)) / 60 + 0.5) as bigint)) as ago from r left join i on i.run_id = r.id left join s on s.run_id = r.id left join u on u.run_id = r.id)
    select site_id, id, status, case when status <> 'running' then critical end as critical, case when status <> 'running' then high end as high, case when status <> 'running' then unexpected end as unexpected, case when status <> 'running' then new_issues end as new_issues,
      case when status <> 'running' then changed_pages end as changed_pages, case when status <> 'running' then cast(id % 101 as bigint) end as overall_score, case when status <> 'running' then ago end as minutes_ago, case when status <> 'running' then ago > 1440 end as is_stale from d""")
def latest_crawl(spark, sf_dir):
    """Each site's latest crawl as the dashboard shows it."""
    r = adapters.runs(spark, sf_dir).withColumn("finished_at", F.expr(FINISHED))
    scores = r.select(F.col("id").alias("run_id"), (F.col("id") % 101).cast("bigint").alias("overall_score"))
    pages = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_partkey") % 11 == 0, "noindex_unexpected").otherwise("indexable").alias("indexing_state"))
    d = dashboard.latest_crawl(r, adapters.issues(spark, sf_dir), adapters.changes(spark, sf_dir), scores, pages, F.lit(dt.datetime(1998, 8, 2, 12)).cast("timestamp_ntz"), 24)
    return d.select("site_id", "id", "status", "critical", "high", "unexpected", "new_issues", "changed_pages", "overall_score", "freshness.minutes_ago", "freshness.is_stale")


# --- changes that count from a size on ----------------------------------------------------

OLD_NEW = "with c as (select cast(p_partkey as integer) as k from part), n as (select k, {now} from c where k % 10 <> 0), o as (select k, {before} from c where k % 12 <> 0), j as (select n.k, {both} from n join o on n.k = o.k)".format(
    now=", ".join(f"{e.format(k=NOW_K)} as {c}" for c, e in PAIRS.items()), before=", ".join(f"{e.format(k=BEFORE_K)} as {c}" for c, e in PAIRS.items()), both=", ".join(f"n.{c} as b_{c}, o.{c} as a_{c}" for c in PAIRS)
)
SQUASHED = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
PLAIN_URL = "regexp_replace({}, '(.)/$', '\\1')"
FAR = "(abs(b_{f} - a_{f}) >= {d} or (a_{f} > 0 and abs(b_{f} - a_{f}) >= {s} * a_{f}))"
FROM_OR_TO_NONE = "(a_{f} > 0 and b_{f} = 0 or a_{f} = 0 and b_{f} > 0 or {far})"
SIZES = {
    "title": ("field_changed", f"{SQUASHED.format('a_title')} <> {SQUASHED.format('b_title')}"),
    "final_url": ("field_changed", f"{PLAIN_URL.format('a_final_url')} <> {PLAIN_URL.format('b_final_url')}"), "canonical": ("canonical_changed", f"{PLAIN_URL.format('a_canonical')} is distinct from {PLAIN_URL.format('b_canonical')}"),
    "word_count": ("field_changed", FAR.format(f="word_count", d=100, s=0.3)), "inbound": ("field_changed", FROM_OR_TO_NONE.format(f="inbound", far="abs(b_inbound - a_inbound) >= 5")),
    "html_size_bytes": ("html_size_changed", FAR.format(f="html_size_bytes", d=102400, s=0.5)), "response_time_ms": ("response_time_changed", "abs(b_response_time_ms - a_response_time_ms) >= 1000 and a_response_time_ms > 0 and abs(b_response_time_ms - a_response_time_ms) >= 0.5 * a_response_time_ms"),
    "internal_link_count": ("link_count_changed", FROM_OR_TO_NONE.format(f="internal_link_count", far=FAR.format(f="internal_link_count", d=10, s=0.4))),
    "external_link_count": ("link_count_changed", FROM_OR_TO_NONE.format(f="external_link_count", far=FAR.format(f="external_link_count", d=10, s=0.4))),
}


@query(OLD_NEW + " " + " union all ".join(f"select k, '{kind}' as event_type, '{history.STORED.get(f, f)}' as field_name, cast(a_{f} as varchar) as previous_value, cast(b_{f} as varchar) as current_value from j where {w}" for f, (kind, w) in SIZES.items()))
def diff_page_sizes(spark, sf_dir):
    """Events of fields whose change counts by amount, share or after cleaning."""
    names = [history.STORED.get(f, f) for f in SIZES]
    e = history.compare_pages(*case_pair(spark, sf_dir)).filter(F.col("field_name").isin(*names))
    return e.select(F.expr("cast(substring(url, 2) as int)").alias("k"), "event_type", "field_name", "previous_value", "current_value")


# --- scores from flags ------------------------------------------------------------------------

FLAGS = {name: f"k % {n} = 0" for n, name in zip((2, 3, 4, 5, 6, 7, 8, 9, 10), (s for s, _, _ in scoring.SIGNALS), strict=True)} | {name: f"k % {n} = 1" for n, (name, _) in zip((3, 5, 7, 11), config.CAPS, strict=True)}
LOST = {c: f"cast((k * {n}) % 60 as double)" for n, c in zip((7, 11, 13, 17, 19, 23), config.WEIGHTS, strict=True)}
PART_SQL = {c: f"greatest(0.0, least(100.0, 100.0 - {LOST[c]} + least(5.0, {' + '.join([f'case when {FLAGS[s]} then {b} else 0 end' for s, kind, b in scoring.SIGNALS if kind == c] or ['0'])})))" for c in config.WEIGHTS}


@query(f"""with p as (select cast(p_partkey as integer) as k from part), r as (select k, {' + '.join(f'{w} * {PART_SQL[c]}' for c, w in config.WEIGHTS.items())} as raw from p),
    c as (select *, least({', '.join(f'case when {FLAGS[n]} and {m} < raw then {m} else 1000 end' for n, m in config.CAPS)}) as cap from r)
    select k, round(raw, 6) as raw, cast(floor(least(raw, cap) + 0.5) as integer) as overall_score, case cap {' '.join(f"when {m} then '{n}'" for n, m in config.CAPS)} end as cap_applied from c""")
def score_flags(spark, sf_dir):
    """Scores from every combination of signals and caps, the homepage's included."""
    d = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"))
    d = d.withColumns({**{n: F.expr(e) for n, e in FLAGS.items()}, **{f"lost_{c}": F.expr(e) for c, e in LOST.items()}})
    return scoring.finished(d).select("k", F.round("raw", 6).alias("raw"), "overall_score", "cap_applied")


# --- stored tables, lookups and what the dashboard's pages derive --------------------------------


@query("""with e as (select user_id as run_id, event_id as seq, case when event_type = 'error' then 'failed' else 'running' end as status, event_type as stage, cast(ts as timestamp) as seen from events)
    select run_id, arg_max(status, seq) as status, arg_max(stage, seq) as stage, min(seen) as started_at, max(seen) as last_progress_at from e group by run_id""")
def run_lifecycle(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events").selectExpr("user_id as run_id", "event_id as seq", "case when event_type = 'error' then 'failed' else 'running' end as status", "event_type as stage", "cast(ts as timestamp_ntz) as at")
    return views.latest_state(e)


@query("""with i as (select l_orderkey as run_id, 'https://h.example/' || (l_partkey % 20) || '/?utm_source=x' as url, 't' || l_linenumber as issue_type from lineitem), p as (select o_orderkey as run_id, 'https://h.example/' || (o_custkey % 20) || '/?utm_source=x' as url, o_orderkey * 10 as id from orders)
    select i.run_id, i.url, regexp_replace(i.url, '/\\?.*$', '') || '::' || issue_type as issue_key, p.id as page_snapshot_id from i left join p on p.run_id = i.run_id and p.url = i.url""")
def issue_snapshot_keys(spark, sf_dir):
    i = adapters.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as run_id", "concat('https://h.example/', l_partkey % 20, '/?utm_source=x') as url", "concat('t', l_linenumber) as issue_type")
    p = adapters.table(spark, sf_dir, "orders").selectExpr("o_orderkey as run_id", "concat('https://h.example/', o_custkey % 20, '/?utm_source=x') as url", "o_orderkey * 10 as id")
    return views.issue_snapshots(i, p).select("run_id", "url", "issue_key", "page_snapshot_id")


@query("select c_custkey as run_id, case when c_custkey % 2 = 0 then 0 else c_custkey % 100 end as overall_score from customer")
def score_upsert(spark, sf_dir):
    old = adapters.table(spark, sf_dir, "customer").selectExpr("c_custkey as run_id", "c_custkey % 100 as overall_score")
    return views.upserted(old, old.filter("run_id % 2 = 0").withColumn("overall_score", F.lit(0).cast("bigint")), "run_id")


@query("select domain, max(base_url) as base_url from (select 's' || (s_suppkey % 30) || '.example' as domain, null as base_url from supplier union all select 's' || c || '.example', 'stored' from range(5) t(c)) group by domain")
def site_get_or_create(spark, sf_dir):
    stored = spark.range(5).selectExpr("concat('s', id, '.example') as domain", "'stored' as base_url")
    new = adapters.table(spark, sf_dir, "supplier").selectExpr("concat('https://s', s_suppkey % 30, '.example/', s_suppkey) as url")
    return views.sites_with(stored, new, F.regexp_extract("url", "^https://([^/]+)/", 1))


@query(f"with {RUNS}, r as (select * from fr where status = 'running'), t as (select *, row_number() over (partition by site_id order by started_at desc, id desc) as n from r) select id, site_id from t where n = 1 and site_id = (select min(site_id) from r)")
def active_run(spark, sf_dir):
    r = adapters.runs(spark, sf_dir)
    first = r.filter("status = 'running'").agg(F.min("site_id")).first()[0]
    return dashboard.active_run(r, first).select("id", "site_id")


@query(f"with {RUNS}, {FC}, s as (select run_id, {SUMMARY} from fc group by run_id), p as (select id, lag(id) over (partition by site_id order by started_at, id) as previous_id from fr) select fr.id, previous_id, coalesce(new_issues, 0) as new_issues, coalesce(resolved_issues, 0) as resolved_issues, coalesce(changed_pages, 0) as changed_pages from fr join p using (id) left join s on s.run_id = fr.id where fr.id = (select min(user_id) from events join orders on o_orderkey = user_id)")
def crawl_detail(spark, sf_dir):
    r, c = adapters.runs(spark, sf_dir), adapters.changes(spark, sf_dir)
    run = r.join(c.select(F.col("run_id").alias("id")), "id", "left_semi").agg(F.min("id")).first()[0]
    return dashboard.crawl_detail(r, c, run).select("id", "previous_id", "new_issues", "resolved_issues", "changed_pages")


@query("""with t as (select o_orderkey as k, o_orderkey % 700 as gone, case when o_orderkey % 5 = 0 then null else true end as seen from orders), c as (select k, case when seen is null then 0 else greatest(0, 300 - gone) end as wait from t)
    select k, cast(wait as bigint) as wait, case when k % 7 = 0 then 'not_configured' when k % 7 = 1 then 'unauthorized' when k % 11 = 0 then 'site_not_found' when wait > 0 then 'cooldown' when k % 3 = 0 then 'already_running' else 'ok' end as answer from c""")
def trigger_answers(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    last = F.when(F.col("k") % 5 != 0, now - F.make_dt_interval(secs=F.col("k") % 700))
    d = d.withColumn("wait", control.cooldown_remaining(last, now).cast("bigint"))
    answer = control.trigger_result(F.expr("case when k % 7 = 0 then null else k % 7 <> 1 end"), F.expr("k % 11 <> 0"), F.col("wait"), F.expr("case when k % 3 = 0 then k end"))
    return d.select("k", "wait", answer.alias("answer"))


@query("""select p_partkey as k, case when p_size % 4 = 0 then 'not recorded' else cast(cast(floor(p_size * 700 / 1024.0 + 0.5) as bigint) as varchar) end as kb, case when p_size % 3 = 0 then 'not recorded' when p_size * 20 > 600 then 'wide' else 'ok' end as width,
    case when p_size % 9 + 1 < 4 then 'pending' when p_size % 9 + 1 = 4 then 'active' else 'done' end as progress, cast(p_size * 61 as bigint) as seconds, coalesce(case when p_size % 2 = 0 then 'current' end, case when p_size % 3 = 0 then 'remembered' end, 'first') as site,
    case when p_size % 4 = 0 then 'network_error' when p_size % 4 = 1 then 'ok' when p_size % 4 = 2 then 'http_error' else 'ok' end as outcome from part where p_size is not null""")
def shown_values(spark, sf_dir):
    """Small derivations of the dashboard's pages."""
    d = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n")).filter("n is not null")
    stages = F.array(*map(F.lit, config.STAGES))
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    return d.select(
        "k", dashboard.kilobytes(F.expr("case when n % 4 <> 0 then n * 700 end")).alias("kb"), dashboard.width_verdict(F.expr("case when n % 3 <> 0 then n * 20 end"), 600).alias("width"),
        dashboard.stage_progress(F.element_at(stages, (F.col("n") % 9 + 1).cast("int")), F.lit(config.STAGES[3])).alias("progress"),
        dashboard.duration_seconds(start, start + F.make_dt_interval(secs=F.col("n") * 61)).cast("bigint").alias("seconds"),
        dashboard.selected_site(F.expr("case when n % 2 = 0 then 'current' end"), F.expr("case when n % 3 = 0 then 'remembered' end"), F.lit("first")).alias("site"),
        scoring.inferred_outcome(F.expr("case n % 4 when 0 then null when 1 then 200 when 2 then 404 else 301 end")).alias("outcome"),
    )


@query(f"with {CASES} select k, url, title from p where page_type = 'episode' and lower(concat_ws(' ', url, title)) like '%ple/1%'")
def page_search(spark, sf_dir):
    return dashboard.search_pages(case_pages(spark, sf_dir), "PLE/1", page_type="episode").select("k", "url", "title")


@query("select user_id as run_id, cast(floor(epoch(cast(ts as timestamp)) / 2) * 2 as bigint) as span, max(cast(ts as timestamp)) as at from events group by all")
def heartbeats_throttled(spark, sf_dir):
    """One heartbeat a run and two seconds."""
    e = adapters.changes(spark, sf_dir).select("run_id", F.col("created_at").alias("at"), F.lit("crawling").alias("stage"))
    d = control.throttled(e)
    return d.select("run_id", F.expr("cast(floor(unix_seconds(cast(at as timestamp)) / 2) * 2 as bigint)").alias("span"), "at")


@query("""with recursive h as (select s_suppkey as k, case when s_suppkey % 4 <> 0 then s_suppkey - 1 end as nxt from supplier), w(k, cur, n) as (select k, k, 0 from h union all select w.k, h.nxt, w.n + 1 from w join h on h.k = w.cur where h.nxt is not null)
    select k, arg_max(cur, n) as final, max(n) as hops from w group by k""")
def redirects(spark, sf_dir):
    """Chains of up to three hops."""
    s = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("url"), F.expr("case when s_suppkey % 4 <> 0 then cast(s_suppkey - 1 as string) end").alias("location"))
    d = discovery.redirect_chains(s.filter("location is not null"), s)
    return d.select(F.col("url").cast("bigint").alias("k"), F.col("final_url").cast("bigint").alias("final"), F.col("redirect_count").alias("hops"))
