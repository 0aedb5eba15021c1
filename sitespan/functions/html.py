"""HTML extraction: one pass over a page's tags gives raw facts; expressions do the rest.

A flat parser in the spirit of the HTML standard for what pages really hold:
void elements, raw-text elements, implied ends of p, li, dt, dd, tr, td, th and
option, and end tags that close what they can find.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .. import config
from .text import pixel_width, utf16_length, word_count
from .urls import host_of, host_of_normalized, resolve

WS = " \t\n\x0b\f\r\xa0                　﻿"
_WS = re.compile(f"[{WS}]+")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = {"script", "style", "noscript", "template"}
LANDMARKS = {"nav", "header", "footer"}
ROLES = {"navigation", "banner", "contentinfo"}
BLOCKS = {"p", "li", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
P_ENDS = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HEAD_ONLY = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}


def trim(s: str) -> str:
    return s.strip(WS)


def squeezed(s: str) -> str:
    return trim(_WS.sub(" ", s))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def unescape_closed(s: str) -> str:
    """Character references that end in a semicolon; what the standard reads without one (a text that breaks off at `&amp`) stays as it is written."""
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], s)


def _integer(digits: str) -> int | float:
    """An integer, or the nearest double where Python reads no integer so long."""
    return int(digits) if len(digits) < 4300 else float(digits)


_DECODER = json.JSONDecoder(parse_int=_integer)
_WHITE = re.compile(r"[ \t\n\r]*+")
_HALVES = re.compile(r"(\\\\|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})|\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


def json_of(text: str):
    """As json.loads, at any depth: what its recursion cannot reach is read once more with the open arrays and objects in a list. Half a pair of \\u escapes, which no column can hold, is U+FFFD."""
    text = _HALVES.sub(lambda m: m[1] or r"\ufffd", text)
    try:
        return _DECODER.decode(text)
    except RecursionError:
        pass
    whole: list = []
    open_, keys, at, need = [whole], [""], 0, "value"
    while True:
        at = _WHITE.match(text, at).end()
        c, inner = text[at : at + 1], open_[-1]
        if need == "comma" and inner is whole:
            if c:
                raise ValueError("text after the value")
            return whole[0]
        if need != "value" and c and c == ("}" if isinstance(inner, dict) else "]") and need in ("comma", "first"):
            open_.pop()
            keys.pop()
            at, need = at + 1, "comma"
        elif need == "comma":
            if c != ",":
                raise ValueError("no comma")
            at, need = at + 1, "key" if isinstance(inner, dict) else "value"
        elif need != "value" and isinstance(inner, dict):
            if c != '"':
                raise ValueError("no key")
            keys[-1], at = _DECODER.raw_decode(text, at)
            at = _WHITE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at, need = at + 1, "value"
        else:
            value, at = ([], at + 1) if c == "[" else ({}, at + 1) if c == "{" else _DECODER.raw_decode(text, at)
            if isinstance(inner, dict):
                inner[keys[-1]] = value
            else:
                inner.append(value)
            need = "comma"
            if c in ("[", "{"):
                open_.append(value)
                keys.append("")
                need = "first"


def types_of(block) -> list[str]:
    """JSON-LD types, through arrays and @graph, in order."""
    out, todo = [], [block]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            t = x.get("@type")
            out += [t] if isinstance(t, str) else [y for y in t if isinstance(y, str)] if isinstance(t, list) else []
            if isinstance(x.get("@graph"), list):
                todo = x["@graph"] + todo
    return out


def episodes_of(block) -> list[dict]:
    out, todo = [], [block]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            t = x.get("@type")
            if t == "PodcastEpisode" or isinstance(t, list) and "PodcastEpisode" in t:
                text = lambda k: x[k] if isinstance(x.get(k), str) and trim(x[k]) else None  # noqa: B023, E731
                n = x.get("episodeNumber")
                number = str(n) if isinstance(n, (int, float)) and not isinstance(n, bool) else text("episodeNumber")
                out.append({"type": "PodcastEpisode", "date_published": text("datePublished"), "date_modified": text("dateModified"), "episode_number": number, "name": text("name"), "url": text("url")})
            if isinstance(x.get("@graph"), list):
                todo = x["@graph"] + todo
    return out


# In this order: tags with a src, and links of three relations between the first and the others.
MIXED_SRC = ["script", "img", "source", "video", "audio", "iframe"]
MIXED_REL = ["stylesheet", "preload", "icon"]
ICONS = {"icon", "shortcut icon", "apple-touch-icon"}

_S = r"[ \t\n\r\f]"
_TAG = re.compile(
    rf"""<(?:
      /(?P<close>[a-zA-Z][^\s/>]*+)[^>]*+>
    | (?P<open>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"'=]++|={_S}*+(?:"[^"]*+"|'[^']*+'|[^>"'\s][^>\s]*+)?|["'])*+)>
    | !--(?:-?>|.*?(?:--!?>|\Z))
    | [!?][^>]*+(?:>|\Z)
    | /[^a-zA-Z>][^>]*+(?:>|\Z)
    | />
    )""",
    re.X | re.S,
)
_ATTR = re.compile(rf"""[\s/]*+(=?[^\s/>=]++|=)(?:{_S}*+={_S}*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_RAW_END, _TEXT_END = ({t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in tags} for tags in (("script", "style"), ("title", "textarea")))
_TAG_BEGINS = re.compile(r"</?[a-zA-Z]")
_UNQUOTED_LAST = re.compile(rf"""={_S}*+[^\s"'][^\s]*+\Z""")
FOREIGN = {"svg", "math"}


class Page:
    """A document as arrays in document order: no object stands for an element.

    Element k has a tag, its attributes as they are written, the texts from
    begin[k] to end[k] and the elements k + 1 to last[k] within. Texts know
    whether an open element hides them.
    """

    __slots__ = ("tags", "written", "begin", "end", "last", "aside", "texts", "shown", "body_from", "body_texts", "decode", "_attrs")

    def __init__(self, html: str, decode: Callable[[str], str] = unescape) -> None:
        self.decode = decode  # of character references in texts
        self.tags, self.written = ["html", "head", "body"], ["", "", ""]
        self.begin, self.end, self.last = [0, 0, 0], [0, 0, 0], [0, 0, 0]
        self.aside = [False] * 3  # is, or stands inside, a part that is no content
        self.texts: list[str] = []
        self.shown: list[int] = []  # 2: visible content, 1: visible, but in a landmark, 0: hidden
        self.body_from, self.body_texts = None, 0
        self._attrs: dict[int, dict[str, str]] = {}
        self.read(html)

    def read(self, html: str) -> None:
        tags, written, begin, end, last, aside, texts, shown = self.tags, self.written, self.begin, self.end, self.last, self.aside, self.texts, self.shown
        stack: list[int] = [1]
        open_p = hidden = marked = set_aside = foreign = 0
        in_head, pending, at, size = True, [], 0, len(html)
        text_ends: dict[str, int] = {}
        fence = 0  # the end of the title or textarea that is being read; nothing in it goes beyond

        def leave_head() -> None:
            nonlocal in_head, hidden, marked, set_aside, open_p
            close_to(1)
            in_head = False
            stack[0] = 2
            self.body_from, self.body_texts = len(tags), len(texts)

        def close_to(depth: int) -> None:
            nonlocal open_p, hidden, marked, set_aside, foreign
            for k in stack[depth:]:
                end[k], last[k] = len(texts), len(tags) - 1
                tag = tags[k]
                open_p -= tag == "p"
                hidden -= tag in HIDDEN
                marked -= tag in LANDMARKS
                foreign -= tag in FOREIGN
                set_aside -= is_aside(k)
            del stack[depth:]

        def is_aside(k: int) -> bool:
            return tags[k] in HIDDEN or tags[k] in LANDMARKS or (written[k] != "" and "role" in written[k].lower() and self.attrs(k).get("role") in ROLES)

        def close(tag: str, limit=frozenset()) -> None:
            for d in range(len(stack) - 1, 0, -1):
                other = tags[stack[d]]
                if other == tag:
                    close_to(d)
                    return
                if other in limit:
                    return

        def start(tag: str, attrs: str) -> None:
            nonlocal open_p, hidden, marked, set_aside, foreign
            if in_head and len(stack) == 1 and tag not in HEAD_ONLY:
                leave_head()
            if open_p and tag in P_ENDS:
                close("p", P_SCOPE)
            for other in IMPLIED.get(tag, ()):
                close(other, SCOPES[tag])
            k = len(tags)
            tags.append(tag)
            written.append(attrs)
            begin.append(len(texts))
            end.append(len(texts))
            last.append(k)
            mine = is_aside(k)
            aside.append(mine or set_aside > 0)
            if tag not in VOID:
                stack.append(k)
                open_p += tag == "p"
                hidden += tag in HIDDEN
                marked += tag in LANDMARKS
                foreign += tag in FOREIGN
                set_aside += mine

        def text(s: str) -> None:
            if in_head and len(stack) == 1:
                if not s.strip(WS):
                    return
                leave_head()
            texts.append(s)
            shown.append(0 if hidden else 1 if marked else 2)

        def text_end(tag: str) -> int:
            """Where the title or textarea that begins here ends; 0 if nothing ends it."""
            if text_ends.get(tag, -1) < at:
                stop = _TEXT_END[tag].search(html, at)
                text_ends[tag] = stop.start() if stop else size
            return text_ends[tag] if text_ends[tag] < size else 0

        def flush() -> None:
            if pending:
                s = "".join(pending)
                pending.clear()
                text(self.decode(s) if "&" in s else s)

        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                pending.append(html[at:])
                break
            if lt > at:
                pending.append(html[at:lt])
            m = _TAG.match(html, lt)
            if m is None and not _TAG_BEGINS.match(html, lt):
                pending.append("<")
                at = lt + 1
                continue
            if lt < fence and (m is None or m.end() > fence):
                pending.append(html[lt:fence])
                at = fence
                continue
            if m is None:  # a tag that the end of the document cuts off
                break
            flush()
            at = m.end()
            if tag := m["open"]:
                tag = tag.lower()
                if tag in ("html", "head", "body"):
                    k = 0 if tag == "html" else 1 if tag == "head" else 2
                    written[k] += " " + m["attrs"]  # of equal names the first counts
                    self._attrs.pop(k, None)
                    if k == 2 and in_head:
                        leave_head()
                    continue
                start(tag, m["attrs"])
                if tag in _TEXT_END and lt >= fence and not foreign:
                    fence = text_end(tag)
                if tag in _RAW_END and foreign and m["attrs"].endswith("/") and not _UNQUOTED_LAST.search(m["attrs"]):
                    close(tag)  # in drawings and formulas a slash closes
                elif tag in _RAW_END:
                    stop = _RAW_END[tag].search(html, at)
                    stop = stop.start() if stop else size
                    if at <= fence:
                        stop = min(stop, fence)
                    if stop > at:
                        text(html[at:stop])
                    at = stop
            elif tag := m["close"]:
                tag = tag.lower()
                if tag == "head":
                    if in_head:
                        leave_head()
                elif tag == "p" and not open_p:
                    start("p", "")
                    close("p")
                else:
                    close(tag)
        flush()
        close_to(1)
        if self.body_from is None:
            self.body_from, self.body_texts = len(tags), len(texts)

    def attrs(self, k: int) -> dict[str, str]:
        """The attributes of an element, read when asked for; of equal names the first counts."""
        found = self._attrs.get(k)
        if found is None:
            found = self._attrs[k] = {}
            for name, value in _ATTR.findall(self.written[k]):
                if value[:1] in ('"', "'") and len(value) > 1 and value[-1] == value[0]:
                    value = value[1:-1]
                found.setdefault(name.lower(), unescape(value) if "&" in value else value)
        return found

    def text(self, k: int) -> str:
        """Text nodes joined without separator."""
        return "".join(self.texts[self.begin[k] : self.end[k]])

    def content(self, k: int) -> str:
        """The text without what is hidden or in landmarks."""
        return "".join(t for t, s in zip(self.texts[self.begin[k] : self.end[k]], self.shown[self.begin[k] : self.end[k]], strict=True) if s == 2)

    def body_text(self) -> str:
        return "".join(t for t, s in zip(self.texts[self.body_texts :], self.shown[self.body_texts :], strict=True) if s)


P_SCOPE = {"button", "table", "td", "th"}
LEVELS = {f"h{k}": k for k in range(1, 7)}


def raw_facts(html: str | None, url: str, decode: Callable[[str], str] = unescape) -> dict:
    """What the markup says, before any rule. An empty document has no facts."""
    page = Page(html or "", decode)
    by: dict[str, list[int]] = {}
    for k, tag in enumerate(page.tags):
        by.setdefault(tag, []).append(k)
    attrs = page.attrs
    metas = [attrs(k) for k in by.get("meta", ())]
    links = [attrs(k) for k in by.get("link", ())]

    def meta(name: str) -> str | None:
        for key in ("name", "property"):
            found = next((m for m in metas if m.get(key, "").lower() == name), None)
            if found is not None and "content" in found:
                return trim(found["content"]) or None
        return None

    canonical = next((m.get("href") for m in links if m.get("rel") == "canonical"), None)
    charset = next((m["charset"] for m in metas if trim(m.get("charset", ""))), None)
    if charset is None:
        equiv = next((m for m in metas if m.get("http-equiv", "").lower() == "content-type"), None)
        found = re.search(r"charset\s*=\s*([^;]+)", equiv.get("content", ""), re.I) if equiv else None
        charset = found[1] if found else None
    headings = [(LEVELS[page.tags[k]], k) for k in sorted(x for t in LEVELS for x in by.get(t, ()))]
    site = host_of(url)
    known: dict[str, tuple[str | None, bool]] = {}

    def target(href: str) -> tuple[str | None, bool]:
        if href not in known:
            u = resolve(href, url)
            known[href] = (u, u is not None and host_of_normalized(u) == site)
        return known[href]

    internal, external, anchors = {}, {}, []
    for k in by.get("a", ()):
        a = attrs(k)
        h = trim(a.get("href", ""))
        if not h:
            continue
        if not h.startswith(("javascript:", "mailto:", "tel:")):
            u, own = target(h)
            if u:
                (internal if own else external)[u] = None
        if h.startswith("#") or _NO_PAGE.match(h):
            continue
        u, own = target(h)
        if not u:
            continue
        name = squeezed(page.text(k))
        if len(name) < config.ANCHOR_LEAST:
            name = squeezed(a.get("aria-label", "")) or squeezed(a.get("title", "")) or name
        if len(name) < config.ANCHOR_LEAST:
            images = (attrs(x) for x in range(k + 1, page.last[k] + 1) if page.tags[x] == "img")
            name = next((x for i in images if len(x := squeezed(i.get("alt", i.get("aria-label", "")))) >= config.ANCHOR_LEAST), name)
        anchors.append({"href": u, "text": name, "is_internal": own})
    content = () if attrs(0).get("role") in ROLES or attrs(2).get("role") in ROLES else range(page.body_from, len(page.tags))
    blocks = [t for k in content if page.tags[k] in BLOCKS and not page.aside[k] and (t := squeezed(page.content(k)).lower())]
    mixed: dict[str, None] = {}
    if url.lower().startswith("https:"):
        sources = [[attrs(k).get("src", "") for k in by.get(tag, ())] for tag in MIXED_SRC]
        related = [[m.get("href", "") for m in links if m.get("rel") == rel] for rel in MIXED_REL]
        for found in [sources[0], *related, *sources[1:]]:
            mixed.update((trim(x), None) for x in found if trim(x).lower().startswith("http://"))
    ld = []
    for k in by.get("script", ()):
        if attrs(k).get("type") == "application/ld+json":
            try:
                ld.append(json_of(page.text(k)))
            except ValueError:  # no JSON
                pass
    images = [attrs(k) for k in by.get("img", ())]
    title = trim(page.text(by["title"][0])) if "title" in by else ""
    return {
        "title": title or None,
        "meta_description": meta("description"),
        "canonical": resolve(canonical, url) if canonical and trim(canonical) else None,
        "robots": meta("robots"),
        "lang": trim(attrs(0).get("lang", "")) or None,
        "has_viewport": any(m.get("name", "").lower() == "viewport" for m in metas),
        "has_favicon": any(m.get("rel", "").lower() in ICONS for m in links),
        "charset": trim(charset) or None if charset else None,
        "has_doctype": bool(re.match(r"(?i)^\s*<!doctype\s+html\s*>", html or "")),
        "body_text": page.body_text(),
        "open_graph": {k: meta(f"og:{k}") for k in ("title", "description", "image")},
        "twitter": {k: meta(f"twitter:{k}") for k in ("card", "title", "description", "image")},
        "headings": [{"level": n, "text": t} for n, k in headings if (t := squeezed(page.text(k)))],
        "h1": [trim(page.text(k)) for n, k in headings if n == 1],
        "images_total": len(images),
        "images_missing_alt": sum(not trim(i.get("alt", "")) for i in images),
        "internal_links": list(internal),
        "external_links": list(external),
        "anchors": anchors,
        "blocks": blocks,
        "mixed_content": list(mixed),
        "alternate_links": [{"hreflang": trim(m["hreflang"]), "href": trim(m.get("href", ""))} for m in links if "alternate" in m.get("rel", "").lower().split() and "hreflang" in m and (trim(m["hreflang"]) or trim(m.get("href", "")))],
        "structured_types": list(dict.fromkeys(t for x in ld for t in types_of(x))),
        "episodes": [e for x in ld for e in episodes_of(x)],
    }


_NO_PAGE = re.compile(r"(?i)(javascript|mailto|tel|data|blob):")


FACTS = (
    "title string, meta_description string, canonical string, robots string, lang string, has_viewport boolean, has_favicon boolean, charset string, has_doctype boolean, body_text string, "
    "open_graph struct<title:string,description:string,image:string>, twitter struct<card:string,title:string,description:string,image:string>, "
    "headings array<struct<level:int,text:string>>, h1 array<string>, images_total int, images_missing_alt int, internal_links array<string>, external_links array<string>, "
    "anchors array<struct<href:string,text:string,is_internal:boolean>>, blocks array<string>, mixed_content array<string>, "
    "alternate_links array<struct<hreflang:string,href:string>>, structured_types array<string>, episodes array<struct<type:string,date_published:string,date_modified:string,episode_number:string,name:string,url:string>>"
)


#: Pages, and bytes of markup, whose facts are held as objects at once.
PART_PAGES, PART_BYTES = 128, 1 << 20


def parts_of(html: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of consecutive parts: none has more than PART_PAGES rows, and none of several rows more than PART_BYTES."""
    at = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if k > at and (k - at == PART_PAGES or size + n > PART_BYTES):
            yield at, k - at
            at, size = k, 0
        size += n
    if len(html) > at:
        yield at, len(html) - at


def with_facts(df: DataFrame, html_col: str = "html", url_col: str = "final_url", decode: Callable[[str], str] = unescape) -> DataFrame:
    """df and its raw facts, extracted once (Arrow batches), with the numbers derived from them.

    A task holds the facts of a few pages as objects, whatever a batch holds:
    each part of a batch is an answer of its own.
    """
    kind = to_arrow_type(StructType.fromDDL(FACTS))

    def batch(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, url in pages:
            for at, n in parts_of(html):
                yield pa.array([raw_facts(h, u or "", decode) for h, u in zip(html.slice(at, n).to_pylist(), url.slice(at, n).to_pylist(), strict=True)], kind)

    facts = F.arrow_udf(batch, FACTS)
    d = df.withColumn("facts", facts(F.col(html_col), F.col(url_col))).select(*df.columns, "facts.*")
    levels = [F.size(F.filter("headings", level_is(k))).alias(f"h{k}_count") for k in range(1, 7)]
    robots = F.lower(F.coalesce("robots", F.lit("")))
    return d.select(
        *d.columns, *levels,
        F.contains(robots, F.lit("noindex")).alias("noindex"), F.contains(robots, F.lit("nofollow")).alias("nofollow"),
        word_count("body_text").alias("word_count"),
        F.octet_length(F.coalesce(html_col, F.lit(""))).alias("html_size_bytes"),
        F.coalesce(utf16_length("title"), F.lit(0)).alias("title_length"),
        F.coalesce(utf16_length("meta_description"), F.lit(0)).alias("meta_description_length"),
        F.when(F.col("title").isNotNull(), pixel_width("title")).alias("title_px"),
        F.when(F.col("meta_description").isNotNull(), pixel_width("meta_description")).alias("meta_description_px"),
        F.size("mixed_content").alias("mixed_content_count"),
        F.slice("mixed_content", 1, config.SAMPLES).alias("mixed_content_samples"),
    )


def level_is(k: int):
    return lambda h: h["level"] == k


# --- facts of flat markup as expressions: first tag by regular expression ----


def _first(html, pattern: str) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.nullif(F.regexp_extract(h, pattern, 1), F.lit(""))


def flat_title(html) -> Column:
    return F.nullif(F.trim(_first(html, r"(?is)<title[^>]*>(.*?)</title>")), F.lit(""))


def flat_lang(html) -> Column:
    return _first(html, r'(?is)<html[^>]*\slang="([^"]*)"')


def flat_charset(html) -> Column:
    return _first(html, r'(?is)<meta[^>]*\scharset="([^"]*)"')


def has_html5_doctype(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return h.rlike(r"(?i)^\s*<!doctype\s+html\s*>")


def publication_state(episodes, now) -> Column:
    """From the first episode with a date: published if it is not after `now` (an explicit time), else scheduled; unknown without a readable one."""
    first = F.get(F.filter(episodes, lambda e: e["date_published"].isNotNull()), F.lit(0))["date_published"]
    mail = F.regexp_replace(F.regexp_replace(first, r"^[A-Za-z]{3},\s*", ""), "(GMT|UTC|Z)$", "+0000")
    at = F.coalesce(F.try_to_timestamp(first), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.when(at.isNull(), "unknown").when(at <= now, "published").otherwise("scheduled")


def server_headers(headers) -> Column:
    """The headers that the audit keeps, from a map with lower-case names."""
    get = lambda k: F.try_element_at(headers, F.lit(k))
    names = ["server", "x-powered-by", "content-type", "cache-control", "content-security-policy", "strict-transport-security"]
    return F.struct(*(get(n).alias(n.replace("-", "_")) for n in names))


def compression(headers) -> Column:
    return F.nullif(F.lower(F.trim(F.try_element_at(headers, F.lit("content-encoding")))), F.lit(""))


def flattened_headers(headers) -> Column:
    """A map of arrays as a map of texts: values joined by a comma, nulls dropped, names in lower case."""
    kept = F.map_filter(headers, lambda k, v: v.isNotNull())
    return F.transform_keys(F.transform_values(kept, lambda k, v: F.array_join(v, ", ")), lambda k, v: F.lower(k))
