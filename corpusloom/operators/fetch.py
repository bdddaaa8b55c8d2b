"""What became of each page: retry folding, error classes and the Markdown-first decision tree, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import content as C
from ..functions import urls as U

OUTCOMES = {
    # order: (status, fetch kind or None for the Markdown kind, note)
    1: ("skipped", "none", "not_modified"),
    2: ("skipped", None, "oversize"),
    3: ("ok", None, None),
    4: ("skipped", "markdown", "markdown_fetch_error"),
    5: ("skipped", "markdown", "markdown_non_text"),
    6: ("skipped", "markdown", "markdown_is_html"),
    7: ("skipped", "markdown", "markdown_not_available"),
    8: ("skipped", "none", "excluded_extension"),
    9: ("skipped", "html", "oversize"),
    10: ("failed", "html", "html_fetch_failed"),
    11: ("skipped", "none", "not_modified"),
    12: ("skipped", "html", "non_text_content_type"),
    13: ("failed", "html", "html_fetch_failed"),
    14: ("skipped", "html", "non_html_text"),
    15: ("failed", "html", "html_to_markdown_failed"),
    16: ("ok", "html", None),
}


#: Outcome -> suffix of its error snapshot; where an HTML outcome has nothing to save, the Markdown's answer is saved under FALLBACK.
SNAPSHOTS = {4: "markdown", 5: "markdown", 6: "markdown", 7: "markdown", 10: "html_exception", 12: "non_text", 13: "html_http", 14: "non_html_text", 15: "html_to_md"}
FALLBACK = "markdown_fallback"


def http_error(status: Column) -> Column:
    return F.when(status == 429, "http_429").when(status.between(400, 499), "http_4xx").when(status.between(500, 599), "http_5xx")


def error_kind(status: Column, exception: Column) -> Column:
    """By status first, then by the exception's class."""
    return F.coalesce(http_error(status), exception)


def retry_limit(kind: Column, config: RunConfig) -> Column:
    out = F.lit(0)
    for name, limit in config.retry_limits.items():
        out = F.when(kind == name, F.lit(limit)).otherwise(out)
    return out


def final_attempts(attempts: DataFrame, config: RunConfig) -> DataFrame:
    """Of the captured attempts (url, attempt from 1, status, error) the one at which a fetch stops: the first that isn't retried."""
    kind = error_kind(F.col("status"), F.col("error"))
    stops = kind.isNull() | (F.col("attempt") > retry_limit(kind, config))
    last = attempts.groupBy("url").agg(F.min(F.when(stops, F.col("attempt"))).alias("stop"), F.max("attempt").alias("last"))
    return attempts.join(last, "url").where(F.col("attempt") == F.coalesce("stop", "last")).drop("stop", "last").withColumn("error_kind", kind)


def backoff(attempt: Column, base: float, most: float, jitter: Column | None = None) -> Column:
    """base x 2^(attempt - 1), capped if most is positive, then the jitter on top; 0 before the first attempt."""
    delay = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    delay = F.least(delay, F.lit(most)) if most > 0 else delay
    return F.when(attempt <= 0, 0.0).otherwise(F.greatest(delay + (jitter if jitter is not None else F.lit(0.0)), F.lit(0.0)))


@dataclass(frozen=True)
class Fetched:
    """Names of the response columns of one half (Markdown or HTML)."""

    prefix: str

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self.prefix}_{name}")

    def oversize(self, most: int) -> Column:
        if most <= 0:
            return F.lit(False)
        return F.coalesce(self.content_length, F.octet_length(self.body), F.lit(0)) > most


MD, HTML = Fetched("md"), Fetched("html")


def markdown_text(config: RunConfig) -> Column:
    """The Markdown twin's body where it is Markdown: status 200, textual, not too large and not HTML in disguise. An empty body counts."""
    good = (MD.status == 200) & C.is_textual(MD.content_type) & ~C.is_probable_html(MD.content_type, MD.body) & ~MD.oversize(config.max_body_bytes)
    return F.when(good, MD.body)


def needs_html(config: RunConfig) -> Column:
    """Rows whose outcome is decided by their HTML: all others never reach the parser."""
    settled = (MD.status == 304) | MD.oversize(config.max_body_bytes) | markdown_text(config).isNotNull()
    return ~F.coalesce(settled, F.lit(False)) & F.lit(config.html_fallback) & ~U.has_extension(F.col("url"), config.exclude_exts)


def outcome(config: RunConfig, converted: Column) -> Column:
    """Order of the decision that holds for a row. converted: the Markdown made of its HTML, or null."""
    html_body = F.when(~HTML.oversize(config.max_body_bytes), HTML.body)
    no_fallback = F.lit(not config.html_fallback)
    md_error = MD.error_kind.isNotNull() | MD.error.isNotNull()
    return (
        F.when(MD.status == 304, 1)
        .when(MD.oversize(config.max_body_bytes), 2)
        .when(markdown_text(config).isNotNull(), 3)
        .when(no_fallback & md_error, 4)
        .when(no_fallback & ~C.is_textual(MD.content_type), 5)
        .when(no_fallback & F.contains(F.lower(F.coalesce(MD.content_type, F.lit(""))), F.lit("text/html")), 6)
        .when(no_fallback, 7)
        .when(U.has_extension(F.col("url"), config.exclude_exts), 8)
        .when(HTML.oversize(config.max_body_bytes), 9)
        .when(html_body.isNull() & ~F.coalesce(HTML.status == 304, F.lit(False)), 10)
        .when(HTML.status == 304, 11)
        .when(~C.is_textual(HTML.content_type), 12)
        .when(HTML.status.isNotNull() & (HTML.status != 200), 13)
        .when(~C.is_probable_html(HTML.content_type, HTML.body), 14)
        .when(converted.isNull(), 15)
        .otherwise(16)
    )


def of_outcome(order: Column, place: int) -> Column:
    """Status (0), fetch kind (1) or note (2) of an outcome: one lookup, so that the tree is named but once where filters are pushed down."""
    return F.element_at(F.array(*[F.lit(OUTCOMES[k][place]).cast("string") for k in sorted(OUTCOMES)]), order)


def md_kind() -> Column:
    return F.when(U.markdown_twin(F.col("url")).endswith(".md.txt"), "markdown_txt").otherwise("markdown")


def snapshot(order: Column) -> Column:
    """suffix and content of the error snapshot that an outcome leaves; null content where there is nothing to save."""
    filled = lambda c: F.when(c != "", c)
    markdown = F.coalesce(filled(MD.body), filled(MD.error))
    own = F.when(order.between(4, 7), markdown).when(order == 10, filled(HTML.error)).when(order.isin(12, 13, 14, 15), HTML.body)
    suffix = F.element_at(F.array(*[F.lit(SNAPSHOTS.get(k)).cast("string") for k in sorted(OUTCOMES)]), order)
    fallback = F.when(order.isin(10, 12, 13, 14, 15), markdown)
    return F.struct(F.when(own.isNotNull(), suffix).when(fallback.isNotNull(), FALLBACK).alias("suffix"), F.coalesce(own, fallback).alias("content"))


def records(rows: DataFrame, config: RunConfig) -> DataFrame:
    """Manifest columns of fetched rows but error_snapshot, and snapshot_suffix, snapshot_content, body and html (FETCH_SCHEMA, source, out_path, cached_*, and page: title, h1, markdown, extractor, null where the HTML wasn't parsed)."""
    order = outcome(config, F.col("page.markdown"))
    body = F.when(F.col("ord") == 3, MD.body).when(F.col("ord") == 16, F.col("page.markdown"))
    by_md = F.col("ord") <= 7
    pick = lambda name: F.when(by_md, getattr(MD, name)).otherwise(getattr(HTML, name))
    unchanged = F.col("ord").isin(1, 11)
    h1 = F.when(F.col("ord") == 3, C.markdown_h1(MD.body)).when(F.col("ord") == 16, F.col("page.h1"))
    kinds = F.when(F.col("ord").isin(2, 9), "unknown").when(F.col("ord").isin(4, 10, 13, 15), F.coalesce(error_kind(pick("status"), pick("error_kind")), F.lit("unknown")))
    return rows.withColumn("ord", order).select(
        "url",
        F.when(by_md & (F.col("ord") == 3), U.markdown_twin(F.col("url"))).otherwise(F.col("url")).alias("fetched_url"),
        "source",
        F.coalesce(of_outcome(F.col("ord"), 1), md_kind()).alias("fetch_kind"),
        of_outcome(F.col("ord"), 0).alias("status"),
        pick("status").cast("int").alias("http_status"),
        pick("content_type").alias("content_type"),
        F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("bytes_written"),
        F.when(body.isNotNull(), F.col("out_path")).alias("out_path"),
        of_outcome(F.col("ord"), 2).alias("note"),
        F.when(F.col("ord").isin(2, 9), "oversize").when(F.col("ord").isin(4, 10, 13, 15), pick("error")).alias("error"),
        kinds.alias("error_kind"),
        F.coalesce(pick("etag"), F.when(unchanged, F.col("cached_etag"))).alias("etag"),
        F.coalesce(pick("last_modified"), F.when(unchanged, F.col("cached_last_modified"))).alias("last_modified"),
        F.when(unchanged, F.col("cached_content_hash")).otherwise(C.content_hash(body)).alias("content_hash"),
        snapshot(F.col("ord"))["suffix"].alias("snapshot_suffix"),
        snapshot(F.col("ord"))["content"].alias("snapshot_content"),
        F.when(F.col("ord") == 3, "markdown").when(F.col("ord").isin(15, 16), F.col("page.extractor")).alias("extractor"),
        F.when(F.col("ord") == 3, h1).when(F.col("ord") == 16, F.col("page.title")).alias("title"),
        h1.alias("h1"),
        body.alias("body"),
        F.when(F.col("ord") == 16, HTML.body).alias("html"),
    )
