"""URL functions as column expressions, and a full resolver for odd and relative URLs.

The expressions take absolute http(s) URLs; anything else is NULL. The resolver
`resolve` follows the URL standard for relative references, dot segments,
user info, ports and percent-encoding, and serves the HTML extraction.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

PARTS = r"^(?i)(https?)://([^/?#\\]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(url, k: int) -> Column:
    """One group of PARTS; empty where absent, NULL where the URL does not parse."""
    u = F.trim(_col(url))
    return F.when(u.rlike(PARTS), F.regexp_extract(u, PARTS, k))


def scheme(url) -> Column:
    return F.lower(part(url, 1))


def host(url) -> Column:
    """Lower-cased host name without user info and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def pathname(url) -> Column:
    """Path, `/` if empty; NULL if the URL does not parse."""
    p = part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def safe_pathname(url) -> Column:
    return F.coalesce(pathname(url), F.lit(""))


def origin(url) -> Column:
    return F.concat(scheme(url), F.lit("://"), _authority(url))


def _authority(url) -> Column:
    a = F.lower(part(url, 2))
    return F.when(scheme(url) == "http", F.regexp_replace(a, r":(80)?$", "")).otherwise(F.regexp_replace(a, r":(443)?$", ""))


def _form(c: Column) -> Column:
    """A name or value as a form serialises it."""
    return F.url_encode(F.coalesce(F.try_url_decode(c), c))


def query_pairs(url) -> Column:
    """Array of (name, value), decoded, in order."""
    raw = F.filter(F.split(F.substring(part(url, 4), 2, 1 << 30), "&"), lambda x: x != "")
    return F.transform(raw, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), F.when(F.instr(x, "=") > 0, F.regexp_replace(x, r"^[^=]*=", "")).otherwise("").alias("value")))


def normalize(url) -> Column:
    """Fragment off, host in lower case, default port off, one trailing slash off, tracking parameters off, others sorted by name."""
    path = pathname(url)
    path = F.when((F.length(path) > 1) & F.endswith(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    kept = F.filter(query_pairs(url), lambda p: ~F.lower(p["name"]).isin(*config.TRACKING_PARAMS))
    placed = F.array_sort(F.transform(kept, lambda p, i: F.struct(p["name"].alias("name"), i.alias("i"), p["value"].alias("value"))))
    query = F.array_join(F.transform(placed, lambda p: F.concat(_form(p["name"]), F.lit("="), _form(p["value"]))), "&")
    return F.concat(origin(url), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def normalized_or_raw(url) -> Column:
    return F.coalesce(normalize(url), _col(url))


def is_http(url) -> Column:
    return F.coalesce(F.trim(_col(url)).rlike(r"^(?i)https?:"), F.lit(False))


def is_same_domain(url, site_host) -> Column:
    return F.coalesce(host(url) == F.lower(_col(site_host)), F.lit(False))


def is_asset(url) -> Column:
    """Whether the last path segment ends in a known file extension."""
    last = F.substring_index(pathname(url), "/", -1)
    return F.coalesce((F.instr(last, ".") > 0) & F.lower(F.substring_index(last, ".", -1)).isin(*config.ASSET_EXTENSIONS), F.lit(False))


def is_crawlable(url) -> Column:
    """Not an asset and few query parameters."""
    return ~is_asset(url) & F.coalesce(F.size(query_pairs(url)) <= config.MOST_QUERY_PARAMS, F.lit(False))


def display_path(url, site_origin) -> Column:
    u, o = _col(url), _col(site_origin)
    rest = F.substring(u, F.length(o) + 1, F.length(u))
    return F.when(F.startswith(u, o), F.when(u == o, F.lit("/")).otherwise(rest)).otherwise(u)


def page_type(url, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """First rule that fits the path's segments; generic otherwise; unknown if the URL does not parse."""
    path = pathname(url)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    out = F.when(path.isNull(), "unknown").when(path == "/", "homepage")
    for kind, first, count in rules or config.PAGE_TYPES:
        n = F.size(segments) >= int(count[:-1]) if count.endswith("+") else F.size(segments) == int(count)
        out = out.when(n & (F.get(segments, F.lit(0)) == first), kind)
    return out.otherwise("generic")


def site_name(url) -> Column:
    return F.coalesce(host(url), _col(url))


def alternate_host(name) -> Column:
    h = _col(name)
    return F.when(F.startswith(F.lower(h), F.lit("www.")), F.substring(h, 5, 1 << 30)).otherwise(F.concat(F.lit("www."), h))


def issue_key(url, issue_type) -> Column:
    return F.concat_ws("::", normalized_or_raw(url), _col(issue_type))


# --- the full resolver, for Python code -------------------------------------

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")
_SAFE_PATH = set(range(0x21, 0x7F)) - set(b'"#<>?`{}')
_FORM = set(b"*-._0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _escaped(text: str, safe: set[int]) -> str:
    if text.isalnum() and text.isascii():
        return text
    return "".join(chr(b) if b in safe else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def _form_text(raw: str) -> str:
    if raw.isalnum() and raw.isascii():
        return raw
    data = unquote_to_bytes(raw.replace("+", " "))
    return "".join(chr(b) if b in _FORM else "+" if b == 32 else f"%{b:02X}" for b in data.decode("utf-8", "replace").encode())


def split_url(raw: str, base: str | None = None) -> tuple[str, str, str, str | None] | None:
    """(scheme, authority, path, query) of an http(s) URL, or of a reference to the base; None if it does not parse."""
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    text = text.partition("#")[0]
    m = _SCHEME.match(text)
    if m and m[1].lower() not in ("http", "https"):
        return None
    if m:
        name, rest = m[1].lower(), text[m.end() :].replace("\\", "/") if "?" not in text else text[m.end() :].partition("?")[0].replace("\\", "/") + "?" + text.partition("?")[2]
        before = _split_base(base) if base else None
        if not rest.startswith("/") and before and before[0] == name:
            return _relative(rest, before)
        return _absolute(name, rest.lstrip("/"))
    before = _split_base(base) if base else None
    if before is None:
        return None
    return _relative(text, before)


@lru_cache(maxsize=64)
def _split_base(base: str) -> tuple[str, str, str, str | None] | None:
    return split_url(base)


def _relative(text: str, before: tuple) -> tuple | None:
    path, mark, query = text.partition("?")
    path = path.replace("\\", "/")
    if path.startswith("//"):
        return _absolute(before[0], text.replace("\\", "/").lstrip("/"))
    if path.startswith("/"):
        return before[0], before[1], _clean(path), query if mark else None
    if path:
        return before[0], before[1], _clean(before[2].rpartition("/")[0] + "/" + path), query if mark else None
    return before[0], before[1], before[2], query if mark else before[3]


def _absolute(name: str, rest: str) -> tuple | None:
    authority, path = re.match(r"([^/?]*)(.*)", rest, re.S).groups()
    path, mark, query = path.partition("?")
    user, at, place = authority.rpartition("@")
    m = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:\[\]]+)(?::(\d*))?", place)
    if not m:
        return None
    try:
        shown = (unquote_to_bytes(m[1]).decode() if "%" in m[1] else m[1]).lower()
    except UnicodeDecodeError:
        return None
    if re.search(r"[\x00-\x20\"#%/:<>?@\\^`{|}\[\]]", shown) and not m[1].startswith("["):
        return None
    port = m[2] and (m[2].lstrip("0") or "0")
    if port and (len(port) > 5 or int(port) > 65535):
        return None
    if port and int(port) != {"http": 80, "https": 443}[name]:
        shown += f":{int(port)}"
    return name, (user + "@" if at else "") + shown, _clean(path or "/"), query if mark else None


def _clean(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, p in enumerate(parts):
        plain = p.lower().replace("%2e", ".")
        last = k == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_escaped(p, _SAFE_PATH))
    return "/" + "/".join(out)


_PLAIN_PATH = re.compile(r"(?:/[A-Za-z0-9_-]+)+/?")


def resolve(raw: str, base: str | None = None) -> str | None:
    """The normalized URL of a reference, by the same rules as `normalize`; None if it does not parse or is not http(s)."""
    if base and _PLAIN_PATH.fullmatch(raw) and (before := _split_base(base)):
        return f"{before[0]}://{before[1]}{raw.removesuffix('/')}"
    got = split_url(raw, base)
    if got is None:
        return None
    name, authority, path, query = got
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    pairs = [p.partition("=") for p in (query or "").split("&") if p]
    kept = sorted(((_form_text(a), _form_text(b)) for a, _, b in pairs if a.lower() not in config.TRACKING_PARAMS), key=lambda p: p[0])
    return f"{name}://{authority}{path}" + ("?" + "&".join(f"{a}={b}" for a, b in kept) if kept else "")


def host_of(url: str | None) -> str | None:
    got = split_url(url) if url else None
    return re.sub(r":\d+$", "", got[1].rpartition("@")[2]) if got else None


def host_of_normalized(url: str) -> str:
    """The host of a URL that `resolve` has made."""
    return re.sub(r":\d+$", "", url.split("/", 3)[2].partition("?")[0].rpartition("@")[2])
