"""The HTML facts by a tree of objects: the plain counterpart of the flat parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from sitespan import config
from sitespan.functions.html import HEAD_ONLY, HIDDEN, ICONS, IMPLIED, LANDMARKS, MIXED_REL, MIXED_SRC, P_ENDS, ROLES, SCOPES, VOID, BLOCKS, WS, episodes_of, squeezed, trim, types_of
from sitespan.functions.urls import host_of, resolve


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self, skip: set[str] = frozenset()) -> str:
        """Text nodes joined without separator."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n is self or n.tag not in skip:
                todo.extend(reversed(n.kids))
        return "".join(out)

    def inside(self, test) -> bool:
        n = self.parent
        while n:
            if test(n):
                return True
            n = n.parent
        return False


class Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.html = Node("html", {}, self.root)
        self.head, self.body = Node("head", {}, self.html), Node("body", {}, self.html)
        self.root.kids.append(self.html)
        self.html.kids += [self.head, self.body]
        self.stack = [self.head]
        self.in_head = True

    def leave_head(self) -> None:
        if self.in_head:
            self.in_head, self.stack = False, [self.body]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in ("html", "body", "head"):
            node = {"html": self.html, "body": self.body, "head": self.head}[tag]
            for k, v in a.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self.leave_head()
            return
        if self.in_head and len(self.stack) == 1 and tag not in HEAD_ONLY:
            self.leave_head()
        if tag in P_ENDS:
            self.close("p", {"button", "table", "td", "th"})
        for other in IMPLIED.get(tag, ()):
            self.close(other, SCOPES[tag])
        node = Node(tag, a, self.stack[-1])
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def close(self, tag: str, limit: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in limit:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.leave_head()
        elif tag == "p" and not any(n.tag == "p" for n in self.stack):
            self.handle_starttag("p", [])
            self.close("p", set())
        else:
            self.close(tag, set())

    def handle_data(self, data: str) -> None:
        if self.in_head and len(self.stack) == 1:
            if not data.strip(WS):
                return
            self.leave_head()
        self.stack[-1].kids.append(data)


def tree(html: str) -> Builder:
    b = Builder()
    b.feed(html)
    HTMLParser.close(b)
    return b


def raw_facts(html: str | None, url: str) -> dict:
    """What the markup says, before any rule. An empty document has no facts."""
    b = tree(html or "")
    nodes = [n for n in b.root.walk()]
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    metas = [n for n in nodes if n.tag == "meta"]
    links = [n for n in nodes if n.tag == "link"]

    def meta(name: str) -> str | None:
        for key in ("name", "property"):
            found = next((m for m in metas if m.attrs.get(key, "").lower() == name), None)
            if found is not None and "content" in found.attrs:
                return trim(found.attrs["content"]) or None
        return None

    title = first("title")
    canonical = next((n.attrs.get("href") for n in links if n.attrs.get("rel") == "canonical"), None)
    charset = next((m.attrs["charset"] for m in metas if trim(m.attrs.get("charset", ""))), None)
    if charset is None:
        equiv = next((m for m in metas if m.attrs.get("http-equiv", "").lower() == "content-type"), None)
        found = re.search(r"charset\s*=\s*([^;]+)", equiv.attrs.get("content", ""), re.I) if equiv else None
        charset = found[1] if found else None
    headings = [(int(n.tag[1]), n) for n in nodes if re.fullmatch("h[1-6]", n.tag)]
    hrefs = [(n, n.attrs["href"]) for n in nodes if n.tag == "a" and "href" in n.attrs]
    site = host_of(url)
    internal, external = {}, {}
    for _, href in hrefs:
        h = trim(href)
        if not h or h.startswith(("javascript:", "mailto:", "tel:")):
            continue
        u = resolve(h, url)
        if u:
            (internal if host_of(u) == site else external)[u] = None
    anchors = []
    for n, href in hrefs:
        h = trim(href)
        if not h or h.startswith("#") or re.match(r"(?i)(javascript|mailto|tel|data|blob):", h):
            continue
        u = resolve(h, url)
        if not u:
            continue
        name = squeezed(n.text())
        if len(name) < config.ANCHOR_LEAST:
            name = squeezed(n.attrs.get("aria-label", "")) or squeezed(n.attrs.get("title", "")) or name
        if len(name) < config.ANCHOR_LEAST:
            shown = (squeezed(x.attrs.get("alt", x.attrs.get("aria-label", ""))) for x in n.walk() if x.tag == "img")
            name = next((x for x in shown if len(x) >= config.ANCHOR_LEAST), name)
        anchors.append({"href": u, "text": name, "is_internal": host_of(u) == site})
    shell = lambda n: n.tag in HIDDEN or n.tag in LANDMARKS or n.attrs.get("role") in ROLES
    visible = (n for n in b.body.walk() if n.tag in BLOCKS and not shell(n) and not n.inside(shell))
    blocks = [t for n in visible if (t := squeezed(n.text(HIDDEN | LANDMARKS)).lower())]
    mixed: dict[str, None] = {}
    if url.lower().startswith("https:"):
        sources = [[n.attrs.get("src", "") for n in nodes if n.tag == tag] for tag in MIXED_SRC]
        related = [[n.attrs.get("href", "") for n in links if n.attrs.get("rel") == rel] for rel in MIXED_REL]
        for found in [sources[0], *related, *sources[1:]]:
            mixed.update((trim(x), None) for x in found if trim(x).lower().startswith("http://"))
    ld = []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                ld.append(json.loads(n.text()))
            except ValueError:
                pass
    images = [n for n in nodes if n.tag == "img"]
    return {
        "title": trim(title.text()) or None if title is not None else None,
        "meta_description": meta("description"),
        "canonical": resolve(canonical, url) if canonical and trim(canonical) else None,
        "robots": meta("robots"),
        "lang": trim(b.html.attrs.get("lang", "")) or None,
        "has_viewport": any(m.attrs.get("name", "").lower() == "viewport" for m in metas),
        "has_favicon": any(n.attrs.get("rel", "").lower() in ICONS for n in links),
        "charset": trim(charset) or None if charset else None,
        "has_doctype": bool(re.match(r"(?i)^\s*<!doctype\s+html\s*>", html or "")),
        "body_text": b.body.text(HIDDEN),
        "open_graph": {k: meta(f"og:{k}") for k in ("title", "description", "image")},
        "twitter": {k: meta(f"twitter:{k}") for k in ("card", "title", "description", "image")},
        "headings": [{"level": k, "text": t} for k, n in headings if (t := squeezed(n.text()))],
        "h1": [trim(n.text()) for k, n in headings if k == 1],
        "images_total": len(images),
        "images_missing_alt": sum(not trim(n.attrs.get("alt", "")) for n in images),
        "internal_links": list(internal),
        "external_links": list(external),
        "anchors": anchors,
        "blocks": blocks,
        "mixed_content": list(mixed),
        "alternate_links": [{"hreflang": trim(n.attrs["hreflang"]), "href": trim(n.attrs.get("href", ""))} for n in links if "alternate" in n.attrs.get("rel", "").lower().split() and "hreflang" in n.attrs and (trim(n.attrs["hreflang"]) or trim(n.attrs.get("href", "")))],
        "structured_types": list(dict.fromkeys(t for x in ld for t in types_of(x))),
        "episodes": [e for x in ld for e in episodes_of(x)],
    }
