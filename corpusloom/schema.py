"""Schemas and value domains of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_VERSION = "1.1"
_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField(name, kind, nullable)
        for name, kind, nullable in [
            ("url", _S, False), ("fetched_url", _S, False), ("source", _S, False), ("fetch_kind", _S, False), ("status", _S, False),
            ("http_status", _I, True), ("content_type", _S, True), ("bytes_written", _L, False), ("out_path", _S, True), ("note", _S, True),
            ("error", _S, True), ("error_kind", _S, True), ("etag", _S, True), ("last_modified", _S, True), ("content_hash", _S, True),
            ("error_snapshot", _S, True), ("extractor", _S, True), ("title", _S, True), ("h1", _S, True), ("run_id", _S, True), ("manifest_version", _S, False),
        ]
    ]
)
INDEX_COLUMNS = ["url", "status", "fetch_kind", "http_status", "content_type", "bytes_written", "out_path", "note", "error", "error_kind", "error_snapshot", "etag", "last_modified", "content_hash", "run_id", "extractor", "title", "h1"]
REQUIRED = ["manifest_version", "url", "status", "fetch_kind", "source"]

#: A captured response for each page: the Markdown twin and the HTML page.
_HALF = [("status", _I), ("content_type", _S), ("content_length", _L), ("body", _S), ("etag", _S), ("last_modified", _S), ("error_kind", _S), ("error", _S)]
FETCH_SCHEMA = T.StructType([T.StructField("url", _S, False), *[T.StructField(f"{p}_{n}", k) for p in ("md", "html") for n, k in _HALF]])

DOMAINS = {
    "source": ["llms_txt", "llms_full", "sitemap", "search_index", "bfs"],
    "fetch_kind": ["none", "markdown", "markdown_txt", "html"],
    "status": ["ok", "skipped", "failed"],
    "extractor": ["auto", "readability", "trafilatura", "raw", "markdown"],
    "error_kind": ["timeout", "connection", "dns", "http_4xx", "http_5xx", "http_429", "unknown"],
    "note": [
        "markdown_not_available", "markdown_fetch_error", "markdown_is_html", "markdown_non_text", "oversize", "excluded_extension", "non_html_text", "max_pages_limit", "html_fetch_failed",
        "html_to_markdown_failed", "non_text_content_type", "path_collision", "resume_skip", "skip_existing", "not_modified", "filtered_out", "robots_disallow", "error_snapshot",
    ],
}


def valid_row() -> Column:
    """Whether a manifest row has its required strings."""
    out = F.lit(True)
    for c in REQUIRED:
        out = out & F.coalesce(F.col(c) != "", F.lit(False))
    return out


def in_domain() -> Column:
    """Whether every enumerated column holds one of its values or null."""
    out = F.lit(True)
    for c, values in DOMAINS.items():
        out = out & (F.col(c).isNull() | F.col(c).isin(values))
    return out
