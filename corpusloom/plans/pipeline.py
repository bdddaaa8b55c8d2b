"""A whole run: URLs and captured responses in, manifest rows out.

Stages in order: normalize, scope, filter (with records), distinct, collisions, limit, robots, skip existing, decide. Records of
rejected URLs are one narrow union; only pages whose HTML decides reach the parser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import content as C
from ..functions import urls as U
from ..functions.html import page_parts
from ..operators import fetch as D
from ..operators import pacing as PA
from ..operators import robots as R
from ..operators import urls as O
from ..schema import MANIFEST_SCHEMA, MANIFEST_VERSION
from ..shared import written

STAGES = {"filtered": 0, "robots": 1, "limited": 2, "collision": 3, "skip_existing": 4, "fetched": 5}


@dataclass
class Run:
    manifest: DataFrame  # MANIFEST_SCHEMA
    bodies: DataFrame  # url, out_path, body of pages that are ok; body with frontmatter where that is asked for
    html: DataFrame  # path, text of the HTML files to keep; none unless they are asked for
    snapshots: DataFrame  # path, text of the error snapshots that the quota admits; none unless they are asked for
    urls: DataFrame  # after the limit, before robots: the lines of urls.txt
    scheduled: DataFrame  # url: what is left to fetch


def rejected(df: DataFrame, note: str | Column, stage: str, source: str, fetched: str = "url") -> DataFrame:
    """Manifest columns of URLs that are skipped before any request."""
    own = {"url": F.col("url"), "fetched_url": F.col(fetched), "source": F.lit(source), "fetch_kind": F.lit("none"), "status": F.lit("skipped"), "bytes_written": F.lit(0).cast("bigint"), "note": F.lit(note) if isinstance(note, str) else note}
    columns = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST_SCHEMA]
    return df.select(*columns, F.lit(STAGES[stage]).alias("stage_ord"))


def path_of(config: RunConfig, url: Column | None = None) -> Column:
    url = F.col("url") if url is None else url
    return U.output_path(url, config.output_dir, config.site_root, config.base_url or None, config.ignore_query_params, config.ignore_query_prefixes)


def kept_aside(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """df, written to the folder that executors share and read back, where one is given: what several branches read is then computed once."""
    return df if folder is None else written(df, f"{folder}/{name}")


def plan_urls(urls: DataFrame, config: RunConfig, source: str, folder: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(URLs kept, with out_path; records of those filtered out, lost to collisions and over the limit)."""
    canonical = O.scoped(O.normalized(urls.select("url"), config), config.scope_prefix).withColumn("note", O.filter_note(F.col("url"), config))
    canonical = kept_aside(canonical, folder, "canonical")
    filtered = rejected(canonical.where("note is not null"), F.col("note"), "filtered", source)
    mapped = kept_aside(O.with_winner(canonical.where("note is null").select("url").distinct(), path_of(config)), folder, "mapped")
    collisions = rejected(mapped.where("url <> winner"), "path_collision", "collision", source, "winner")
    unique = mapped.where("url = winner").select("url", "out_path")
    kept = O.first_urls(unique, config.max_pages)
    limited = [rejected(O.remainder(unique, kept), "max_pages_limit", "limited", source)] if config.max_pages > 0 else []
    return kept, [filtered, *limited, collisions]


def run(urls: DataFrame, responses: DataFrame, config: RunConfig, source: str = "sitemap", robots_txt: str | None = None, existing: DataFrame | None = None, cache: DataFrame | None = None, run_id: str | None = None, folder: str | None = None, fetched_at: str | None = None) -> Run:
    """urls: url. responses: FETCH_SCHEMA. existing: out_path. cache: url, etag, last_modified, content_hash.

    folder: a fresh one that executors share, for what several branches read. fetched_at: the time that frontmatter states."""
    kept, records = plan_urls(urls, config, source, folder)
    scheduled, disallowed, _ = R.split_by_robots(kept, None if config.ignore_robots else robots_txt, config.user_agent)
    records.append(rejected(disallowed, "robots_disallow", "robots", source))
    if existing is not None and config.skip_existing:
        scheduled, there = O.skip_existing(scheduled, existing)
        records.append(rejected(there, "skip_existing", "skip_existing", source))
    rows = scheduled.join(responses, "url", "left").withColumn("source", F.lit(source))
    if cache is not None:
        rows = rows.join(cache.select("url", *[F.col(c).alias(f"cached_{c}") for c in ("etag", "last_modified", "content_hash")]), "url", "left")
    else:
        rows = rows.withColumns({f"cached_{c}": F.lit(None).cast("string") for c in ("etag", "last_modified", "content_hash")})
    needs = D.needs_html(config)
    page = page_parts(F.coalesce("html_body", F.lit("")), config.content_extractor)
    parsed = rows.where(needs).withColumn("page", page)
    others = rows.where(~needs).withColumn("page", F.lit(None).cast(parsed.schema["page"].dataType))
    fetched = D.records(parsed.unionByName(others), config)
    stamped = {"run_id": F.lit(run_id).cast("string"), "manifest_version": F.lit(MANIFEST_VERSION)}
    named = with_snapshots(fetched, config, run_id or "")
    text = C.truncated(F.col("snapshot_content"), config.error_snapshot_max_bytes, config.error_snapshot_sample_ratio)
    taken = named.where("error_snapshot is not null").select(F.col("error_snapshot").alias("path"), text.alias("text"))
    manifest = named.withColumns(stamped).withColumn("stage_ord", F.lit(STAGES["fetched"])).select(*MANIFEST_SCHEMA.names, "stage_ord")
    for r in records:
        manifest = manifest.unionByName(r.withColumns(stamped))
    ok = fetched.where("status = 'ok'")
    head = C.frontmatter(F.col("url"), F.col("fetched_url"), F.lit(fetched_at) if fetched_at and config.frontmatter_timestamp else None)
    bodies = ok.select("url", "out_path", F.concat(head, F.col("body")).alias("body") if config.frontmatter else F.col("body"))
    html = ok.where(F.col("html").isNotNull() & F.lit(config.save_html)).select(U.html_path(F.col("out_path")).alias("path"), F.col("html").alias("text"))
    return Run(manifest, bodies, html, taken, kept.select("url"), scheduled.select("url"))


def schedule(urls: DataFrame, config: RunConfig, robots_txt: str | None = None) -> DataFrame:
    """url, start: the second at which each URL may be asked for, in the order of the URLs, under the configured rates and the crawl delay of robots.txt."""
    group = None if config.ignore_robots or not robots_txt else R.group_for(R.parse_robots(robots_txt), config.user_agent)
    delay = group["delay"] if group else None
    rows = urls.select("url", U.part(F.col("url"), U.NETLOC).alias("host"), F.lit(0.0).alias("at"), F.col("url").alias("ord"))
    by_host = PA.host_paced(rows, PA.interval_of(R.delayed_rate(config.host_rate_limit_per_sec, delay)))
    by_all = PA.paced(by_host.select("url", F.col("start").alias("at"), "ord"), PA.interval_of(R.delayed_rate(config.rate_limit_per_sec, delay)))
    return by_all.select("url", "start")


def with_snapshots(fetched: DataFrame, config: RunConfig, run_id: str) -> DataFrame:
    """Adds error_snapshot: the path of a row's snapshot, null where there is nothing to save, none is asked for, or the quota is used up. With a quota snapshots are
    admitted in the order of a hash of their URLs."""
    folder = f"{config.report_dir or config.output_dir + '/_report'}/_errors/"
    path = F.concat(F.lit(folder), C.snapshot_name(F.col("url"), F.col("snapshot_suffix"), run_id))
    named = fetched.withColumn("error_snapshot", F.when(F.col("snapshot_content").isNotNull() & F.lit(config.save_error_html), path))
    if not config.save_error_html or (config.error_snapshot_max_files <= 0 and config.error_snapshot_max_total_bytes <= 0):
        return named
    text = C.truncated(F.col("snapshot_content"), config.error_snapshot_max_bytes, config.error_snapshot_sample_ratio)
    sized = named.where("error_snapshot is not null").select("url", F.lit(run_id).alias("run_id"), F.xxhash64("url").alias("ord"), F.octet_length(text).cast("bigint").alias("size"))
    admitted = O.snapshot_quota(sized, config.error_snapshot_max_files, config.error_snapshot_max_total_bytes).select("url", F.lit(True).alias("admitted"))
    return named.join(admitted, "url", "left").withColumn("error_snapshot", F.when(F.col("admitted"), F.col("error_snapshot"))).drop("admitted")
