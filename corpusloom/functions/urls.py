"""URL expressions: splitting, canonical form, predicates and output paths. All are Column expressions, without UDFs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme, authority, path, query, fragment; any part may be missing.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, NETLOC, PATH, QUERY, FRAGMENT = range(1, 6)
LAST_PARAMS = r"(?s)^((?:.*/)?[^/;]*);([^/]*)$"
# Names that Windows reserves, and characters that it forbids in file names.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]]
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1F]'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def part(url: Column, which: int) -> Column:
    """A part of the URL; the path comes without the parameters (;...) of its last segment."""
    found = F.regexp_extract(url, PARTS, which)
    return F.regexp_replace(found, LAST_PARAMS, "$1") if which == PATH else found


def params(url: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(url, PARTS, PATH), LAST_PARAMS, 2)


def url_split(url: Column) -> Column:
    names = ["scheme", "netloc", "path", "query", "fragment"]
    return F.struct(*[part(url, i + 1).alias(n) for i, n in enumerate(names)])


def _decoded(text: Column) -> Column:
    """Percent-decoded, + as a space; a malformed escape leaves the text as it is."""
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(text), plain)


def _encoded(text: Column) -> Column:
    """Form-encoded: the JVM's encoder keeps * and escapes ~, where * must be escaped and ~ kept."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column, ignore: Sequence[str] = (), ignore_prefixes: Sequence[str] = ()) -> Column:
    """Pairs decoded, without ignored keys, sorted by key and value, encoded again; blank values stay."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), _pair)
    if ignore:
        pairs = F.filter(pairs, lambda p: ~p["k"].isin(*ignore))
    for prefix in ignore_prefixes:
        pairs = _without_prefix(pairs, prefix)
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _pair(p: Column) -> Column:
    value = F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)
    return F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(value).alias("v"))


def _without_prefix(pairs: Column, prefix: str) -> Column:
    return F.filter(pairs, lambda p: ~p["k"].startswith(prefix))


def normalize_url(url: Column, ignore: Sequence[str] = (), ignore_prefixes: Sequence[str] = ()) -> Column:
    """Lower-case scheme and authority, no default port, no trailing slashes, no fragment, canonical query."""
    scheme, netloc, path = F.lower(part(url, SCHEME)), F.lower(part(url, NETLOC)), part(url, PATH)
    netloc = F.when(scheme == "http", F.regexp_replace(netloc, ":80$", "")).when(scheme == "https", F.regexp_replace(netloc, ":443$", "")).otherwise(netloc)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    tail = F.concat(path, F.when(params(url) != "", F.concat(F.lit(";"), params(url))).otherwise(""))
    query = canonical_query(part(url, QUERY), ignore, ignore_prefixes)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when((netloc != "") | part(url, 0).contains("://"), F.concat(F.lit("//"), netloc)).otherwise(""), F.when((netloc != "") & (tail != "") & ~tail.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def extension(url: Column) -> Column:
    """Extension of the last path component in lower case, with its dot; names that only begin with dots have none."""
    return F.regexp_extract(F.lower(part(url, PATH)), r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)


def has_extension(url: Column, extensions: Sequence[str]) -> Column:
    return extension(url).isin(*extensions) & (extension(url) != "")


def in_scope(url: Column, prefix: str | None) -> Column:
    """Whether the path starts with the prefix, as a plain string ('/docs' takes in '/docs2')."""
    return part(url, PATH).startswith(prefix if prefix.startswith("/") else "/" + prefix) if prefix else F.lit(True)


def same_origin(a: Column, b: Column) -> Column:
    return (part(a, SCHEME) == part(b, SCHEME)) & (part(a, NETLOC) == part(b, NETLOC))


def crawl_scope(base_url: str, scope_prefix: str | None = None) -> str:
    """Scope of a crawl: as given, else from the base path: a page's folder, or a folder itself."""
    if scope_prefix:
        return scope_prefix
    path = urlsplit(base_url).path
    if path in ("", "/"):
        return "/"
    if path.endswith("/"):
        return path.rstrip("/") or "/"
    segments = path.strip("/").split("/")
    if len(segments) == 1 and "." not in segments[0]:
        return "/" + segments[0]
    return path.rsplit("/", 1)[0] or "/"


def candidate_bases(base_url: str) -> list[str]:
    """Origin and up to two leading path segments, the most specific first."""
    split = urlsplit(base_url)
    segments = [s for s in split.path.split("/") if s]
    return ["/".join([f"{split.scheme.lower()}://{split.netloc.lower()}", *segments[:n]]) for n in range(min(2, len(segments)), -1, -1)]


# -- Output paths ------------------------------------------------------------------------------------------------------------------


def sha1_head(text: Column, n: int) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def query_suffix(url: Column, ignore: Sequence[str] = (), ignore_prefixes: Sequence[str] = ()) -> Column:
    query = part(url, QUERY)
    return F.when(query == "", "").otherwise(F.concat(F.lit("__q_"), sha1_head(canonical_query(query, ignore, ignore_prefixes), 8)))


def sanitize_segment(segment: Column) -> Column:
    """A path segment as a file name: percent-decoded, trimmed, without forbidden characters or reserved names, at most 89 characters."""
    decoded = F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)
    bounded = lambda c: F.when(F.length(c) > 120, F.concat(F.substring(c, 1, 80), F.lit("_"), sha1_head(c, 8))).otherwise(c)
    named = lambda c: let(F.when(F.upper(c).isin(RESERVED), F.concat(F.lit("_"), c, F.lit("_"))).otherwise(c), bounded)
    clean = lambda p: F.when(p.isin(".", "..", ""), "_").otherwise(let(F.regexp_replace(p, FORBIDDEN, "_"), named))
    return let(F.regexp_replace(decoded, r"(?U)^\s+|\s+$", ""), clean)


def _joined(path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_join(F.transform(segments, sanitize_segment), "/")


def relative_path(url: Column, ignore: Sequence[str] = (), ignore_prefixes: Sequence[str] = ()) -> Column:
    """Sanitized path of a URL, 'index' for the root, with the query's suffix."""
    named = let(_joined(part(url, PATH)), lambda j: F.when(j == "", "index").otherwise(j))
    return F.concat(named, query_suffix(url, ignore, ignore_prefixes))


def relative_path_from(url: Column, base_url: str, slug: str | None, ignore: Sequence[str] = (), ignore_prefixes: Sequence[str] = ()) -> Column:
    """relative_path below the base's path (on a segment boundary); the base itself is the slug; what is elsewhere keeps its whole path, and its query is then hashed with no key ignored."""
    base = "/" + urlsplit(base_url).path.strip("/")
    if base == "/":
        return relative_path(url)
    own = sanitize_segment(F.lit(slug)) if slug else F.lit("index")

    def of(path: Column) -> Column:
        rest = let(_joined(F.substring(path, len(base) + 1, 2147483647)), lambda r: F.when(r == "", own).otherwise(r))
        return F.when((path == base) | path.startswith(base + "/"), F.concat(rest, query_suffix(url, ignore, ignore_prefixes))).otherwise(relative_path(url))

    return let(F.concat(F.lit("/"), F.regexp_replace(part(url, PATH), "^/+|/+$", "")), of)


def md_name(path: Column) -> Column:
    return let(path, lambda p: F.when(p.endswith(".md") | p.endswith(".md.txt"), p).otherwise(F.concat(p, F.lit(".md"))))


def output_path(url: Column, out: str, site_root: str | None = None, base_url: str | None = None, ignore: Sequence[str] = (), ignore_prefixes: Sequence[str] = ()) -> Column:
    path = relative_path_from(url, base_url, site_root, ignore, ignore_prefixes) if base_url and site_root else relative_path(url, ignore, ignore_prefixes)
    return F.concat(F.lit("/".join([out, *([site_root] if site_root else [])]) + "/"), md_name(path))


def html_path(md: Column) -> Column:
    return F.regexp_replace(md, r"\.md(\.txt)?$", ".html")


def markdown_twin(url: Column) -> Column:
    return F.when(url.endswith(".md") | url.endswith(".md.txt"), url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".md")))


def relative_to(path: Column, folder: str) -> Column:
    """The path below the folder; a path elsewhere stays as it is."""
    prefix = folder.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2147483647)).otherwise(path)
