"""Run settings: defaults, TOML profiles and the command line, in rising order of precedence.

Settings stay on the driver; expressions take them as literals."""

from __future__ import annotations

import argparse
import re
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any
from urllib.parse import urlsplit

# File extensions that are never documentation pages.
DEFAULT_EXCLUDE_EXTS = (".css", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".js", ".map", ".mp4", ".pdf", ".png", ".svg", ".tar", ".tgz", ".webp", ".zip")


@dataclass(frozen=True)
class RunConfig:
    """Names and defaults are those that profiles and options use."""

    # Where from, where to
    base_url: str = ""
    output_dir: str = "out"
    report_dir: str | None = None
    site_root: str | None = None
    # Which URLs (plans/pipeline.plan_urls, plans/crawl)
    scope_prefix: str | None = None
    exclude_exts: tuple[str, ...] = DEFAULT_EXCLUDE_EXTS
    include_regex: str | None = None
    exclude_regex: str | None = None
    ignore_query_params: tuple[str, ...] = ()
    ignore_query_prefixes: tuple[str, ...] = ("utm_",)
    ignore_robots: bool = False
    max_pages: int = 5000
    max_depth: int = 6
    # How pages are decided and written (operators/fetch, plans/pipeline.run)
    max_body_bytes: int = 0
    html_fallback: bool = True
    content_extractor: str = "auto"
    frontmatter: bool = False
    frontmatter_timestamp: bool = True
    save_html: bool = False
    save_error_html: bool = True
    error_snapshot_max_bytes: int = 200_000
    error_snapshot_sample_ratio: float = 0.7
    error_snapshot_max_files: int = 0
    error_snapshot_max_total_bytes: int = 0
    # Earlier runs, and the ledger
    resume: bool = False
    skip_existing: bool = False
    dry_run: bool = False
    manifest_sorted: bool = False
    manifest_cache_max_entries: int = 0
    # Which attempt counts (operators/fetch.final_attempts, backoff)
    retry_total: int = 4
    retry_timeout: int = 2
    retry_connection: int = 2
    retry_dns: int = 1
    retry_http_429: int = 3
    retry_http_5xx: int = 2
    retry_unknown: int = 0
    retry_backoff_base: float = 0.5
    retry_backoff_max: float = 8.0
    retry_backoff_jitter: float = 0.3
    # When requests may go out (plans/pipeline.schedule, operators/pacing), and for whom robots.txt speaks
    rate_limit_per_sec: float = 5.0
    host_rate_limit_per_sec: float = 0.0
    host_max_concurrency: int = 0
    user_agent: str = "Mozilla/5.0 (corpusloom/0.1)"
    # For whoever captures: no plan reads these
    max_workers: int = 8
    request_timeout: int = 20
    headers: Mapping[str, str] = field(default_factory=dict)
    cookies: Mapping[str, str] = field(default_factory=dict)
    auth: tuple[str, str] | None = None
    token: str | None = None

    @property
    def retry_limits(self) -> dict[str, int]:
        """Retries per error class; a class that isn't named is never retried."""
        return {"timeout": self.retry_timeout, "connection": self.retry_connection, "dns": self.retry_dns, "http_429": self.retry_http_429, "http_5xx": self.retry_http_5xx, "unknown": self.retry_unknown}


def exclude_extensions(extra: Iterable[str] | None) -> tuple[str, ...]:
    """The default extensions and those of comma-separated lists, trimmed, in lower case and with a dot."""
    more = ("." + e.strip().lower().removeprefix(".") for part in extra or () for e in part.split(",") if e.strip())
    return tuple(sorted({*DEFAULT_EXCLUDE_EXTS, *more}))


def usable_pattern(pattern: str | None) -> str | None:
    """The pattern, or None (no filter) where it is empty or no regular expression."""
    try:
        return pattern if pattern and re.compile(pattern) else None
    except re.error:
        return None


def jvm_pattern(pattern: str) -> str | None:
    """The pattern as the JVM's dialect writes it (named groups and references, end of text); None where it has forms that only Python has."""
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", out).replace("\\Z", "\\z")
    return None if re.search(r"\(\?P|\(\?\(|\(\?[aLu]|\\N\{|\[\[|&&|\[\]|\[\^\]", out) else out


def comma_list(values: Iterable[str] | None) -> tuple[str, ...]:
    return tuple(p.strip() for v in values or () for p in v.split(",") if p.strip())


def as_bool(value: Any) -> bool:
    word = str(value).strip().lower()
    return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else bool(value)


def key_values(items: Iterable[str] | None, mark: str) -> dict[str, str]:
    """Headers (mark ':') or cookies (mark '='): split at the first mark; items without one are skipped."""
    parts = (i.partition(mark) for i in items or ())
    return {k.strip(): v.strip() for k, found, v in parts if found and k.strip()}


def auth_pair(value: Any) -> tuple[str, str] | None:
    """A pair, a mapping with user and password, or 'user:password'."""
    if isinstance(value, str):
        user, found, password = value.partition(":")
        return (user, password) if found else None
    if isinstance(value, Mapping):
        user = value.get("user") or value.get("username")
        return (str(user), str(value.get("password", ""))) if user else None
    return (str(value[0]), str(value[1])) if value and len(value) == 2 else None


def load_profile(path: str | None, name: str | None = None) -> dict[str, Any]:
    """The named profile of a TOML file, else its [profile]; {} where there is none or the file can't be read."""
    try:
        with open(path or "", "rb") as f:
            data = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return {}
    named = (data.get("profiles") or {}).get(name) if name else None
    found = named if isinstance(named, dict) else data.get("profile")
    return found if isinstance(found, dict) else {}


def site_root_of(base_url: str) -> str | None:
    segments = [s for s in urlsplit(base_url).path.split("/") if s]
    return segments[-1] if segments else None


# -- Command line: option -> setting, and how its text is read -------------------------------------------------------------------

FLAGS = {"--frontmatter": "frontmatter", "--dry-run": "dry_run", "--resume": "resume", "--skip-existing": "skip_existing"}
TRI_STATE = {"--save-html": "save_html", "--save-error-html": "save_error_html", "--ignore-robots": "ignore_robots", "--manifest-sorted": "manifest_sorted"}
VALUES: dict[str, tuple[str, type]] = {
    "--out": ("output_dir", str), "--site-root": ("site_root", str), "--report-dir": ("report_dir", str),
    "--workers": ("max_workers", int), "--timeout": ("request_timeout", int), "--rate": ("rate_limit_per_sec", float), "--host-rate": ("host_rate_limit_per_sec", float), "--host-concurrency": ("host_max_concurrency", int),
    "--max-pages": ("max_pages", int), "--max-depth": ("max_depth", int), "--scope-prefix": ("scope_prefix", str), "--max-body-bytes": ("max_body_bytes", int),
    "--include-regex": ("include_regex", str), "--exclude-regex": ("exclude_regex", str), "--content-extractor": ("content_extractor", str),
    "--retry": ("retry_total", int), "--retry-timeout": ("retry_timeout", int), "--retry-connection": ("retry_connection", int), "--retry-dns": ("retry_dns", int), "--retry-429": ("retry_http_429", int), "--retry-5xx": ("retry_http_5xx", int), "--retry-unknown": ("retry_unknown", int),
    "--retry-backoff": ("retry_backoff_base", float), "--retry-backoff-max": ("retry_backoff_max", float), "--retry-jitter": ("retry_backoff_jitter", float),
    "--auth": ("auth", str), "--token": ("token", str), "--user-agent": ("user_agent", str),
    "--error-snapshot-max-bytes": ("error_snapshot_max_bytes", int), "--error-snapshot-sample-ratio": ("error_snapshot_sample_ratio", float), "--error-snapshot-max-files": ("error_snapshot_max_files", int), "--error-snapshot-max-total-bytes": ("error_snapshot_max_total_bytes", int),
    "--manifest-cache-max-entries": ("manifest_cache_max_entries", int),
}
LISTS = {"--exclude-ext": "exclude_exts", "--ignore-query": "ignore_query_params", "--ignore-query-prefix": "ignore_query_prefixes", "--header": "headers", "--cookie": "cookies"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Audit a documentation corpus from tables of URLs and captured responses.")
    p.add_argument("base_url")
    p.add_argument("--urls", help="Parquet table of URLs (url); without it URLs are discovered")
    p.add_argument("--responses", help="Parquet table of captured responses")
    p.add_argument("--payloads", help="Parquet table of captured robots.txt, llms.txt, sitemaps and search indexes (url, status, content_type, body)")
    for option, dest in FLAGS.items():
        p.add_argument(option, dest=dest, action="store_const", const=True)
    p.add_argument("--frontmatter-no-timestamp", dest="frontmatter_timestamp", action="store_const", const=False)
    p.add_argument("--no-html", dest="html_fallback", action="store_const", const=False)
    for option, dest in TRI_STATE.items():
        p.add_argument(option, dest=dest, action=argparse.BooleanOptionalAction, default=None)
    for option, (dest, kind) in VALUES.items():
        p.add_argument(option, dest=dest, type=kind, **({"choices": ("auto", "readability", "trafilatura", "raw", "markdown")} if dest == "content_extractor" else {}))
    for option, dest in LISTS.items():
        p.add_argument(option, dest=dest, action="append")
    p.add_argument("--profile")
    p.add_argument("--profile-name")
    p.add_argument("--verbose", action="store_true")
    return p


def from_args(args: argparse.Namespace) -> RunConfig:
    """Settings by precedence: command line, profile, defaults. A run from the command line retries each class --retry times, unknown errors never."""
    profile = load_profile(args.profile, args.profile_name)
    given = {f.name: getattr(args, f.name) for f in fields(RunConfig) if getattr(args, f.name, None) is not None}
    pick = {f.name: given.get(f.name, profile.get(f.name)) for f in fields(RunConfig)}
    total = pick["retry_total"] if pick["retry_total"] is not None else RunConfig.retry_total
    for kind in ("timeout", "connection", "dns", "http_429", "http_5xx"):
        if pick[f"retry_{kind}"] is None:
            pick[f"retry_{kind}"] = total
    both = {k: {**key_values(v, m), **key_values(getattr(args, k), m)} if isinstance(v := profile.get(k), list) else {**(v or {}), **key_values(getattr(args, k), m)} for k, m in (("headers", ":"), ("cookies", "="))}
    listed = lambda v: [v] if isinstance(v, str) else v
    chosen = {k: v for k, v in pick.items() if v is not None and k not in ("headers", "cookies", "exclude_exts", "auth")}
    for k in ("ignore_query_params", "ignore_query_prefixes"):
        if k in chosen:
            chosen[k] = comma_list(listed(chosen[k]))
    for k in {*FLAGS.values(), *TRI_STATE.values(), "frontmatter_timestamp", "html_fallback"} & chosen.keys():
        chosen[k] = as_bool(chosen[k])
    if chosen.get("site_root") == "auto":
        chosen["site_root"] = site_root_of(args.base_url)
    return replace(RunConfig(), **chosen, **both, exclude_exts=exclude_extensions(listed(pick["exclude_exts"])), auth=auth_pair(pick["auth"]))
