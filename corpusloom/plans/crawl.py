"""Breadth-first crawl over a table of captured pages, exact in its first-in-first-out order and its page budget.

Each level is a join of the frontier with the pages. A URL's rank is where it stands in the queue: levels in turn, then the rank of
the page it was found on, then its place there. State is written between levels, so lineage stays short."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import content as C
from ..functions import urls as U
from ..functions.html import page_parts
from ..operators import robots as R
from ..operators.urls import filter_note
from ..shared import written


def resolve(base: Column, href: Column) -> Column:
    """An href against the page it stands on, as RFC 3986 has it, but for two things that urljoin does too: references with the base's scheme and no
    authority are relative, and what climbs above the root stays there."""
    clean = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    parts = lambda url: F.struct(*[U.part(url, k).alias(n) for n, k in (("scheme", U.SCHEME), ("netloc", U.NETLOC), ("path", U.PATH), ("query", U.QUERY), ("fragment", U.FRAGMENT))], U.params(url).alias("params"))
    plain = href.rlike(r"^/([^/?#;\x00-\x20][^?#;\t\r\n]*)?$") & ~href.contains("/.")  # a path with nothing to resolve: most links are
    origin = F.concat(F.lower(U.part(base, U.SCHEME)), F.lit("://"), U.part(base, U.NETLOC))
    whole = U.let(parts(base), lambda b: U.let(clean, lambda h: U.let(parts(h), lambda r: F.when(h == "", base).otherwise(_resolved(b, h, r)))))
    return F.when(plain, F.concat(origin, href)).otherwise(whole)


def _resolved(b: Column, href: Column, r: Column) -> Column:
    mark = lambda sign, text: F.when(text == "", "").otherwise(F.concat(F.lit(sign), text))
    whole = lambda netloc, path, params, query: F.concat(F.lower(b["scheme"]), F.lit("://"), netloc, F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), mark(";", params), mark("?", query), mark("#", r["fragment"]))
    folder = F.split(b["path"], "/")
    folder = F.when(F.element_at(folder, -1) == "", folder).otherwise(F.slice(folder, 1, F.size(folder) - 1))
    inner = lambda all_: F.concat(F.slice(all_, 1, 1), F.filter(F.slice(all_, 2, F.greatest(F.size(all_) - 2, F.lit(0))), lambda x: x != ""), F.when(F.size(all_) > 1, F.slice(all_, -1, 1)).otherwise(F.array().cast("array<string>")))
    segments = F.when(r["path"].startswith("/"), F.split(r["path"], "/")).otherwise(U.let(F.concat(folder, F.split(r["path"], "/")), inner))

    def joined(all_: Column) -> Column:
        step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
        kept = F.aggregate(all_, F.array().cast("array<string>"), step)
        path = F.array_join(F.concat(kept, F.when(F.element_at(all_, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
        return F.when(path == "", "/").otherwise(path)

    here = (r["path"] == "") & (r["params"] == "")
    beside = F.when(here, whole(b["netloc"], b["path"], b["params"], F.when(r["query"] == "", b["query"]).otherwise(r["query"]))).otherwise(whole(b["netloc"], U.let(segments, joined), r["params"], r["query"]))
    foreign = (r["scheme"] != "") & (F.lower(r["scheme"]) != F.lower(b["scheme"]))
    return F.when(foreign, href).when(r["netloc"] != "", whole(r["netloc"], r["path"], r["params"], r["query"])).otherwise(beside)


def edges(pages: DataFrame, config: RunConfig) -> DataFrame:
    """src, pos, dst of every link that passes the filters. pages: url, html. Extensions are tested before normalizing, patterns after."""
    hrefs = pages.select(F.col("url").alias("src"), F.posexplode(page_parts(F.col("html"), markdown=False)["links"]).alias("pos", "href"))
    absolute = _once(hrefs, resolve(F.col("src"), F.col("href")), "raw").where(~U.has_extension(F.col("raw"), config.exclude_exts))
    out = _once(absolute, U.normalize_url(F.col("raw"), config.ignore_query_params, config.ignore_query_prefixes), "dst")
    return out.where(filter_note(F.col("dst"), config).isNull())


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """src, pos and the value, computed once a row: a plain column would be put in wherever the next steps name it, time and again within one another."""
    return df.select("src", "pos", F.explode(F.array(value)).alias(name))


def crawl(pages: DataFrame, config: RunConfig, folder: str, robots_txt: str | None = None, links: DataFrame | None = None) -> DataFrame:
    """url of every page that a crawl from base_url visits and accepts. pages: url (canonical), status, content_type, html.

    folder: where levels are written; executors share it. links: edges made before, else they are taken from the pages' HTML."""
    spark, folder = pages.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    scope = U.crawl_scope(config.base_url, config.scope_prefix)
    group = R.group_for(R.parse_robots(robots_txt), config.user_agent) if robots_txt and not config.ignore_robots else None
    fits = (F.col("status") == 200) & C.is_textual(F.col("content_type")) & C.is_probable_html(F.col("content_type"), F.col("html"))
    if config.max_body_bytes > 0:
        fits = fits & (F.octet_length("html") <= config.max_body_bytes)
    good = pages.where(fits & filter_note(F.col("url"), config).isNull() & (R.allowed(F.col("url"), group["rules"]) if group else F.lit(True)))
    if links is None:
        links = edges(good.select("url", "html"), config)
    in_scope = U.same_origin(F.col("dst"), U.normalize_url(F.lit(config.base_url))) & (F.lit(True) if scope == "/" else U.part(F.col("dst"), U.PATH).startswith(scope))
    # What each level reads is tested once: the pages' URLs, and the links in scope.
    links = written(links.where(in_scope), f"{folder}/edges")
    good = written(good.select("url"), f"{folder}/good")

    seed = spark.range(1).select(U.normalize_url(F.lit(config.base_url), config.ignore_query_params, config.ignore_query_prefixes).alias("url"), F.lit(0).cast("bigint").alias("rank"))
    visited = written(seed, f"{folder}/level-0")
    frontier, count = visited, 1
    for depth in range(1, config.max_depth + 1):
        if count >= config.max_pages > 0:
            break
        accepted = frontier.join(good, "url", "left_semi")
        found = links.join(accepted, links.src == accepted.url).groupBy("dst").agg(F.min(F.struct("rank", "pos")).alias("at"))
        new = found.join(visited, found.dst == visited.url, "left_anti").select(F.col("dst").alias("url"), "at")
        ordered = new.orderBy("at.rank", "at.pos", "url")
        if config.max_pages > 0:
            ordered = ordered.limit(config.max_pages - count)
        # Places in the sorted level: partitions hold ranges in order, so the rows' own ids rise in queue order.
        frontier = written(ordered.select("url", (F.monotonically_increasing_id() + F.lit(depth << 50)).alias("rank")), f"{folder}/level-{depth}")
        more = frontier.count()
        if not more:
            break
        visited, count = visited.unionByName(frontier), count + more
    return visited.join(good, "url", "left_semi").select("url").distinct()
