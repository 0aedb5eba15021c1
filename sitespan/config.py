"""Fixed values of the audit: word lists, thresholds, weights and tables."""

from __future__ import annotations

# --- fixed values: URLs
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gclsrc", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid"]
ASSET_EXTENSIONS = (
    "jpg jpeg png gif svg webp avif ico bmp tiff css js mjs map json xml pdf doc docx xls xlsx ppt pptx zip rar 7z csv txt "
    "woff woff2 ttf eot otf mp4 mov avi webm mkv mp3 wav m4a ogg"
).split()
MOST_QUERY_PARAMS = 2

# --- fixed values: page types, first match wins; (type, first segment, exact number of segments or least with +)
PAGE_TYPES = [("episodes_index", "episodes", "1"), ("episode", "episodes", "2+"), ("booking", "booking", "1"), ("service", "booking", "2+")]

# --- fixed values: glyph widths
GLYPHS = [(4.5, "ijlI.,'!|:;’‘"), (6.0, "ftr()[]\"-/\\"), (14.0, "MWmw@%"), (5.0, " ")]
DIGIT_WIDTH, UPPER_WIDTH, LOWER_WIDTH, OTHER_WIDTH = 9.0, 10.5, 8.0, 9.0

# --- fixed values: thresholds
TITLE_LEAST, TITLE_MOST_PX, DESCRIPTION_MOST_PX = 20, 600, 950
LEAST_WORDS = {"episode": 75, "episodes_index": 100, "booking": 100, "service": 150, "generic": 150, "unknown": 150}
TITLE_MATTERS = ["homepage", "episode", "episodes_index"]
HEADING_REPEATS, HEADING_RATIO, HEADING_LEAST, HEADING_WORDS = 3, 0.12, 8, 30
GENERIC_ANCHORS = ["click here", "read more", "learn more", "here", "more", "this link", "link", "click"]
ANCHOR_LEAST, AMBIGUOUS_LEAST = 2, 3
BLOCK_LEAST, SAMPLES, BLOCK_SHOWN, BLOCKS_MEDIUM = 45, 5, 160, 3
COMPRESS_FROM = 5120
HREFLANG = r"(?i)^(x-default|[a-z]{2,3}(-[a-z0-9]{2,8})*)$"

# --- fixed values: changes
WORDS_DELTA, WORDS_SHARE = 100, 0.3
INBOUND_DELTA = 5
LINKS_DELTA, LINKS_SHARE = 10, 0.4
BYTES_DELTA, BYTES_SHARE = 102_400, 0.5
MILLIS_DELTA, MILLIS_SHARE = 1000, 0.5

# --- fixed values: scoring
SEVERITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}
BASE_PENALTY = {"critical": 20.0, "high": 10.0, "medium": 4.0, "low": 1.0}
WEIGHTS = {"technical": 0.2, "onPage": 0.2, "content": 0.15, "internalLinks": 0.15, "indexing": 0.2, "performance": 0.1}
TIERS = [(1, 1.0), (5, 0.75), (20, 0.4)]
TIER_REST = 0.2
MOST_BONUS = 5
CAPS = [("any_critical_issue", 69), ("homepage_5xx", 50), ("homepage_unexpected_noindex", 40), ("site_uncrawlable", 20)]
UNCRAWLABLE = 0.9
LABELS = [(90, "Excellent"), (80, "Healthy"), (70, "Needs Attention"), (50, "Poor")]
LABEL_REST = "Critical"
CATEGORY = {
    "technical": {
        "crawl_failure": 1.5, "server_error": 1.5, "client_error": 0.0, "host_canonicalization_issue": 1.2, "mixed_content": 1.2,
        "missing_charset": 0.5, "missing_doctype": 0.5, "x_powered_by_exposed": 0.3, "missing_favicon": 0.3,
    },
    "onPage": {
        "missing_title": 1.2, "title_pixel_width_high": 0.5, "title_too_short": 1.0, "missing_canonical": 1.2, "canonical_external_domain": 1.3,
        "missing_meta_description": 1.0, "meta_description_pixel_width_high": 0.5, "missing_h1": 1.0, "multiple_h1": 0.8, "missing_lang": 0.5,
        "missing_open_graph": 0.4, "missing_twitter": 0.3, "duplicate_title": 1.2, "duplicate_meta_description": 1.0, "images_missing_alt": 0.4,
    },
    "content": {
        "low_word_count": 0.6, "duplicate_visible_content": 1.0, "missing_podcast_episode_schema": 0.9, "duplicate_heading_text": 0.7,
        "heading_hierarchy_skip": 0.4, "excessive_headings": 0.3,
    },
    "internalLinks": {"broken_internal_links": 1.2, "empty_internal_anchor": 0.8, "generic_anchor_text": 0.25, "ambiguous_repeated_anchor_text": 0.4},
    "indexing": {
        "sitemap_url_redirect": 1.0, "sitemap_url_noindex": 1.1, "indexable_page_missing_from_sitemap": 1.0, "orphaned_sitemap_page": 0.7,
        "unexpected_noindex": 1.5, "noindex_requires_review": 0.6, "hreflang_missing_href": 0.8, "invalid_hreflang": 0.4, "hreflang_duplicate_language": 0.8,
    },
    "performance": {"html_response_uncompressed": 0.5},
}

# --- fixed values: publication states of an episode that allow or forbid noindex
NOINDEX_ALLOWED = {"episode": ["scheduled", "draft"]}
NOINDEX_FORBIDDEN = {"episode": ["published"]}

# --- fixed values: change events
HIGH_PRIORITY_EVENTS = [
    "indexability_changed", "indexing_state_changed", "http_status_changed", "canonical_changed",
    "page_added_to_sitemap", "page_removed_from_sitemap", "page_became_discovered", "page_no_longer_discovered",
]
EVENT_CATEGORIES = {
    "new_issues": ["issue_new"],
    "resolved": ["issue_resolved"],
    "page_changes": ["page_new", "page_removed", "field_changed", "http_status_changed"],
    "indexing": ["indexability_changed", "indexing_state_changed", "publication_state_changed"],
    "sitemap": ["page_added_to_sitemap", "page_removed_from_sitemap", "page_became_discovered", "page_no_longer_discovered"],
    "metadata": ["canonical_changed", "severity_changed"],
}
EVENT_LABELS = {
    "issue_new": "New Issue", "issue_ongoing": "Ongoing Issue", "issue_resolved": "Resolved", "severity_changed": "Severity Changed",
    "page_new": "New Page", "page_removed": "Missing Page", "field_changed": "Metadata Changed", "indexability_changed": "Indexability Changed",
    "indexing_state_changed": "Indexing Changed", "publication_state_changed": "Publication State Changed", "page_added_to_sitemap": "Added to Sitemap",
    "page_removed_from_sitemap": "Removed from Sitemap", "page_became_discovered": "Became Discovered", "page_no_longer_discovered": "No Longer Discovered",
    "http_status_changed": "HTTP Status Changed", "canonical_changed": "Canonical Changed",
}
PAGE_TYPE_LABELS = {"homepage": "Homepage", "episode": "Episode", "episodes_index": "Episodes Index", "booking": "Booking", "service": "Service", "generic": "Generic", "unknown": "Unknown"}
STATE_LABELS = {"indexable": "Indexable", "noindex_expected": "Noindex (Expected)", "noindex_review": "Noindex (Needs Review)", "noindex_unexpected": "Noindex (Unexpected)"}
CATEGORY_LABELS = {"technical": "Technical SEO", "onPage": "On-Page SEO", "content": "Content Quality", "internalLinks": "Internal Linking", "indexing": "Indexing & Crawlability", "performance": "Performance / Server"}
MODULE_LABELS = {"technical": "TECHNICAL", "onPage": "ON-PAGE", "content": "CONTENT", "internalLinks": "LINKING", "indexing": "INDEXING", "performance": "PERFORMANCE"}
ISSUE_LABELS = {
    "crawl_failure": "Crawl Failure", "server_error": "Server Error", "client_error": "Client Error", "sitemap_url_redirect": "Sitemap URL Redirects",
    "sitemap_url_noindex": "Sitemap URL Is Noindex", "missing_title": "Missing Title", "title_too_long": "Title May Be Too Long", "title_too_short": "Title Too Short",
    "missing_canonical": "Missing Canonical", "canonical_external_domain": "Canonical Points Off-Site", "missing_meta_description": "Missing Meta Description",
    "meta_description_too_long": "Meta Description Too Long", "missing_h1": "Missing H1", "multiple_h1": "Multiple H1 Tags", "broken_internal_links": "Broken Internal Links",
    "images_missing_alt": "Images Missing Alt Text", "missing_open_graph": "Missing Open Graph Tags", "missing_twitter": "Missing Twitter Card Tags",
    "missing_lang": "Missing Language Attribute", "missing_favicon": "Missing Favicon", "low_word_count": "Low Content", "missing_podcast_episode_schema": "Missing Podcast Episode Schema",
    "duplicate_title": "Duplicate Title", "duplicate_meta_description": "Duplicate Meta Description", "indexable_page_missing_from_sitemap": "Missing From Sitemap",
    "orphaned_sitemap_page": "Orphaned Sitemap Page", "unexpected_noindex": "Unexpected Noindex", "noindex_requires_review": "Noindex Needs Review",
    "duplicate_heading_text": "Duplicate Heading Text", "heading_hierarchy_skip": "Heading Hierarchy Skip", "excessive_headings": "Excessive Headings",
    "empty_internal_anchor": "Empty Internal Link Text", "generic_anchor_text": "Generic Anchor Text", "ambiguous_repeated_anchor_text": "Ambiguous Repeated Anchor Text",
    "duplicate_visible_content": "Duplicate Page Content", "missing_charset": "Missing Charset Declaration", "missing_doctype": "Missing HTML5 Doctype",
    "mixed_content": "Mixed HTTP/HTTPS Content", "html_response_uncompressed": "HTML Not Compressed", "x_powered_by_exposed": "X-Powered-By Header Exposed",
    "host_canonicalization_issue": "Host Canonicalization Issue", "invalid_hreflang": "Invalid Hreflang Value", "hreflang_missing_href": "Hreflang Missing Href",
    "hreflang_duplicate_language": "Duplicate Hreflang Language", "title_pixel_width_high": "Title May Be Too Wide", "meta_description_pixel_width_high": "Meta Description May Be Too Wide",
}
STAGES = ["initializing", "discovering", "crawling", "analyzing", "persisting", "comparing", "scoring", "completed", "failed"]

# --- defaults of a run
DEFAULTS = {
    "concurrency": 5, "request_timeout_ms": 10_000, "delay_ms": 250, "max_pages": 0, "discover_links": True, "max_discovered_pages": 100, "max_crawl_depth": 3,
    "stale_minutes": 15, "timeout_minutes": 45, "cooldown_seconds": 300, "redirect_limit": 10, "freshness_hours": 24,
}

# --- fixed values: recommendations by issue type
RECOMMENDATIONS = {
    "crawl_failure": "Investigate connectivity, DNS, TLS, or server-side errors preventing this page from loading.",
    "server_error": "Fix the server-side error causing this page to fail.",
    "client_error": "Fix the broken link/route, or remove this URL from the sitemap if it no longer exists.",
    "sitemap_url_redirect": "Update the sitemap to reference the final destination URL directly.",
    "sitemap_url_noindex": "Remove this URL from the sitemap, or remove the noindex directive if it should be indexed.",
    "missing_title": "Add a unique, descriptive title tag between 20 and 60 characters.",
    "title_pixel_width_high": "Shorten the title or use narrower wording so it's less likely to be truncated in search results.",
    "title_too_short": "Consider expanding the title to better describe the page's content (around 20+ characters).",
    "missing_canonical": "Add a self-referencing (or otherwise correct) canonical tag.",
    "canonical_external_domain": "Verify this is intentional; otherwise point the canonical back to this domain.",
    "missing_meta_description": "Add a unique meta description under 160 characters summarizing the page.",
    "meta_description_pixel_width_high": "Shorten the meta description so it's less likely to be truncated in search results.",
    "missing_h1": "Add a single, descriptive H1 heading to the page.",
    "multiple_h1": "Use a single H1 heading per page for clear topical structure.",
    "broken_internal_links": "Update or remove links pointing to pages that return errors.",
    "images_missing_alt": "Add descriptive alt text to all meaningful images for accessibility and image SEO.",
    "missing_open_graph": "Add og:title, og:description, and og:image tags for better social sharing previews.",
    "missing_twitter": "Add twitter:card and related meta tags for better previews on X/Twitter.",
    "missing_lang": 'Add a lang attribute to the <html> element (e.g. lang="en").',
    "missing_favicon": 'Add a <link rel="icon"> tag pointing to a favicon.',
    "low_word_count": "Consider whether this page has enough unique content to be useful and indexable.",
    "missing_podcast_episode_schema": "Add PodcastEpisode structured data describing the episode.",
    "duplicate_heading_text": "Use distinct, descriptive heading text for each section of the page.",
    "heading_hierarchy_skip": "Use consecutive heading levels for a clear document outline (e.g. H1 then H2, not H1 then H3).",
    "excessive_headings": "Confirm this heading density is intentional (e.g. a listing/grid page) rather than over-structured content.",
    "empty_internal_anchor": "Give every internal link meaningful visible text or an aria-label describing its destination.",
    "generic_anchor_text": "Replace generic anchor text with text that describes the linked page.",
    "ambiguous_repeated_anchor_text": "Use distinct anchor text for links that lead to different pages.",
    "duplicate_visible_content": "Check whether repeated content blocks are intentional (e.g. a shared component) or accidental duplication.",
    "missing_charset": 'Add a <meta charset="UTF-8"> tag (or equivalent) near the top of <head>.',
    "missing_doctype": "Add <!DOCTYPE html> as the first line of the document.",
    "mixed_content": "Update these resource URLs to HTTPS (or protocol-relative/relative URLs) to avoid mixed-content warnings and blocked resources.",
    "html_response_uncompressed": "Enable gzip or brotli compression on the server for HTML responses.",
    "x_powered_by_exposed": "Consider removing the X-Powered-By header as routine operational/security hygiene (this does not directly affect rankings).",
    "hreflang_missing_href": 'Every rel="alternate" hreflang link needs a valid href pointing to the translated/regional page.',
    "invalid_hreflang": 'Use valid ISO 639-1 language codes, optionally with an ISO 3166-1 region (e.g. "en", "en-US"), or "x-default".',
    "hreflang_duplicate_language": "Declare each hreflang language/region exactly once, pointing to a single canonical URL for that variant.",
    "duplicate_title": "Write a unique title for each page.",
    "duplicate_meta_description": "Write a unique meta description for each page.",
    "indexable_page_missing_from_sitemap": "Add this canonical URL to the sitemap if the page is intended to appear in search results.",
    "orphaned_sitemap_page": "Add relevant internal links to this page if it should be discoverable through normal site navigation.",
    "unexpected_noindex": "Remove the noindex directive if this episode is intended to appear in organic search.",
    "noindex_requires_review": "Confirm whether this page should be indexed once its release/publication status is known.",
}
CANONICAL_INVALID = "Use a valid absolute URL for the canonical tag."
