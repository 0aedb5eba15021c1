"""Settings from environment variables, checked when they are read."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit


def _number(least: float, whole: bool = True, above: bool = False) -> Callable[[str], float]:
    def read(text: str) -> float:
        v = float(text.strip() or "nan")
        if v != v or abs(v) == float("inf") or (whole and v != int(v)) or v < least or (above and v == least):
            raise ValueError(f"must be a {'whole ' if whole else ''}number {'above' if above else 'of at least'} {least:g}")
        return int(v) if whole else v

    return read


def _one_of(*names: str) -> Callable[[str], str]:
    def read(text: str) -> str:
        if text not in names:
            raise ValueError(f"must be one of {', '.join(names)}")
        return text

    return read


def _switch(text: str) -> bool:
    return _one_of("true", "false")(text) == "true"


def _site(text: str) -> str:
    u = urlsplit(text)
    if not u.scheme or not u.hostname:
        raise ValueError("must be an absolute URL, such as https://example.com")
    return text


def _text(least: int) -> Callable[[str], str]:
    def read(text: str) -> str:
        if len(text) < least:
            raise ValueError(f"must have {least} characters or more")
        return text

    return read


@dataclass(frozen=True)
class Setting:
    name: str
    read: Callable[[str], object]
    default: object = None
    required: bool = False
    empty_is_unset: bool = False


# Names and defaults of the settings.
SETTINGS = {
    "site_url": Setting("SITE_URL", _site, required=True),
    "concurrency": Setting("MAX_CONCURRENCY", _number(0, above=True), 5),
    "request_timeout_ms": Setting("REQUEST_TIMEOUT", _number(0, above=True), 10_000),
    "delay_ms": Setting("REQUEST_DELAY_MS", _number(0), 250),
    "user_agent": Setting("USER_AGENT", _text(1), "SiteBot/1.0"),
    "max_pages": Setting("MAX_PAGES", _number(0), 0),
    "discover_links": Setting("DISCOVER_INTERNAL_URLS", _switch, True),
    "max_discovered_pages": Setting("MAX_DISCOVERED_PAGES", _number(0), 100),
    "max_crawl_depth": Setting("MAX_CRAWL_DEPTH", _number(0), 3),
    "persist": Setting("PERSIST_RESULTS", _switch, False),
    "dashboard_port": Setting("DASHBOARD_PORT", _number(0, above=True), 4173),
    "environment": Setting("DASHBOARD_ENVIRONMENT", _one_of("local", "development", "production"), "local"),
    "freshness_hours": Setting("DASHBOARD_STALE_HOURS", _number(0, whole=False, above=True), 24.0),
    "admin_token": Setting("DASHBOARD_ADMIN_TOKEN", _text(16), empty_is_unset=True),
    "stale_minutes": Setting("SEO_SCAN_STALE_MINUTES", _number(0, whole=False, above=True), 15.0),
    "timeout_minutes": Setting("SEO_AUDIT_TIMEOUT_MINUTES", _number(0, whole=False, above=True), 45.0),
    "cooldown_seconds": Setting("SEO_MANUAL_SCAN_COOLDOWN_SECONDS", _number(0, whole=False), 300.0),
}


def settings(env: Mapping[str, str] | None = None) -> dict[str, object]:
    """All settings by name, and site_host; every fault is told at once."""
    env = os.environ if env is None else env
    out: dict[str, object] = {}
    wrong = []
    for key, s in SETTINGS.items():
        raw = env.get(s.name)
        if raw is None or (raw == "" and s.empty_is_unset):
            out[key] = s.default
            if s.required:
                wrong.append(f"{s.name}: is required")
            continue
        try:
            out[key] = s.read(raw)
        except ValueError as e:
            wrong.append(f"{s.name}: {e}")
    if wrong:
        raise ValueError("settings that cannot be used:\n" + "\n".join(f"  - {w}" for w in wrong))
    out["site_host"] = urlsplit(str(out["site_url"])).hostname
    return out
