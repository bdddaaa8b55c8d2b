"""Expressions over bodies and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends besides LF: VT, FF, FS, GS, RS, NEL and the two Unicode separators.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


# Fixed value: what stands for the bytes left out of a snapshot.
TRUNCATED = b"\n...[truncated]...\n"


def content_type_name(content_type: Column) -> Column:
    """Media type without parameters in lower case; 'unknown' for none."""
    name = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when(F.coalesce(content_type, F.lit("")) == "", "unknown").otherwise(name)


def is_textual(content_type: Column) -> Column:
    name = content_type_name(content_type)
    return (F.coalesce(content_type, F.lit("")) == "") | name.startswith("text/") | name.isin("application/xhtml+xml", "application/xml") | name.endswith("+xml")


def is_probable_html(content_type: Column, body: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)^[\s\x1C-\x1F]+", ""), 1, 200))
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")) | head.startswith("<!doctype") | head.startswith("<html")


def content_hash(body: Column) -> Column:
    return F.sha1(body.cast("binary"))


def markdown_h1(text: Column) -> Column:
    """First line that starts with '# ' after a leading block between two '---' lines; an unterminated block hides all."""
    lines = F.transform(F.split(text, LINE_ENDS), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))

    def after(all_: Column) -> Column:
        rest = F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))
        end = F.array_position(rest, "---").cast("int")
        open_ = F.element_at(all_, 1) == "---"
        body = F.when(open_ & (end == 0), F.array().cast("array<string>")).when(open_, F.slice(rest, end + 1, F.greatest(F.size(rest) - end, F.lit(0)))).otherwise(all_)
        return F.trim(F.substring(F.get(F.filter(body, lambda line: line.startswith("# ")), F.lit(0)), 3, 2147483647))

    return F.transform(F.array(lines), after)[0]


def frontmatter(url: Column, fetched_url: Column, fetched_at: Column | None = None) -> Column:
    lines = [F.lit("---"), F.concat(F.lit("source_url: "), url), F.concat(F.lit("fetched_url: "), fetched_url)]
    lines += [F.concat(F.lit("fetched_at_utc: "), fetched_at)] if fetched_at is not None else []
    return F.concat_ws("\n", *lines, F.lit("---"), F.lit(""))


def snapshot_name(url: Column, suffix: str | Column, run_id: str = "") -> Column:
    head = [F.lit(run_id)] if run_id else []
    return F.concat(F.concat_ws("_", *head, F.substring(F.sha1(url.cast("binary")), 1, 10), F.lit(suffix) if isinstance(suffix, str) else suffix), F.lit(".txt"))


def truncated(body: Column, most: int, head_ratio: float = 0.7) -> Column:
    """At most so many bytes: the head and tail around a marker; code points cut in two are dropped."""
    if most <= 0:
        return body
    marker, raw = TRUNCATED, body.cast("binary")
    ratio = head_ratio if 0.1 <= head_ratio <= 0.9 else 0.7
    if most <= len(marker):
        return F.when(F.octet_length(body) <= most, body).otherwise(_head(raw, most))
    head = int((most - len(marker)) * ratio)
    tail = most - len(marker) - head
    return F.when(F.octet_length(body) <= most, body).otherwise(F.concat(_head(raw, head), F.lit(marker.decode()), _tail(raw, tail)))


def _head(raw: Column, n: int) -> Column:
    """The first n bytes as text, without a code point that is cut: of the last three bytes, those are dropped without which the rest is valid."""
    tries = [F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(4) if n - k >= 0]
    return F.coalesce(*tries, F.lit(""))


def _tail(raw: Column, n: int) -> Column:
    start = F.greatest(F.octet_length(raw) - n, F.lit(0))
    tries = [F.try_validate_utf8(F.substring(raw, start + 1 + k, F.lit(n)).cast("string")) for k in range(4)]
    return F.coalesce(*tries, F.lit(""))
