"""Relational operators over discovered URLs: filters, collisions, limits, set operations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig, jvm_pattern, usable_pattern
from ..functions import urls as U


def normalized(df: DataFrame, config: RunConfig, column: str = "url") -> DataFrame:
    return df.withColumn(column, U.normalize_url(F.col(column), config.ignore_query_params, config.ignore_query_prefixes))


def scoped(df: DataFrame, prefix: str | None) -> DataFrame:
    """Rows whose path starts with the prefix; the others leave no record."""
    return df.where(U.in_scope(F.col("url"), prefix)) if prefix else df


def found_in(url: Column, pattern: str) -> Column:
    """Whether the pattern is found in the URL: by the JVM, or in batches by Python where only Python reads the pattern."""
    java = jvm_pattern(pattern)
    if java is not None:
        return url.rlike(java)

    @F.pandas_udf("boolean")
    def search(urls: pd.Series) -> pd.Series:
        ready = re.compile(pattern)
        return urls.map(lambda u: u is not None and ready.search(u) is not None)

    return search(url)


def filter_note(url: Column, config: RunConfig) -> Column:
    """Why a URL is rejected: excluded_extension, then filtered_out; null if it is kept. Extensions only ever add to the defaults."""
    include, exclude = usable_pattern(config.include_regex), usable_pattern(config.exclude_regex)
    passes = F.lit(True)
    if include:
        passes = passes & found_in(url, include)
    if exclude:
        passes = passes & ~found_in(url, exclude)
    return F.when(U.has_extension(url, config.exclude_exts), "excluded_extension").when(~passes, "filtered_out")


def same_origin_as(df: DataFrame, base_url: str) -> DataFrame:
    """Rows of the base's scheme and authority. The base is taken in its canonical form, so that an upper-case base works too."""
    base = U.normalize_url(F.lit(base_url))
    return df.where(U.same_origin(F.col("url"), base))


def with_winner(urls: DataFrame, path: Column) -> DataFrame:
    """Adds out_path and winner: of the distinct URLs that map to one path, the smallest. Map-side aggregation keeps a hot path cheap."""
    mapped = urls.withColumn("out_path", path)
    best = mapped.groupBy("out_path").agg(F.min("url").alias("winner"))
    return mapped.join(best, "out_path")


def first_urls(urls: DataFrame, most: int) -> DataFrame:
    """The first so many URLs in code-point order: a top-k, never one task over all rows."""
    return urls.orderBy("url").limit(most) if most > 0 else urls


def remainder(urls: DataFrame, kept: DataFrame) -> DataFrame:
    return urls.join(kept.select("url"), "url", "left_anti")


def skip_existing(urls: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(URLs still to fetch, URLs whose out_path exists). existing: out_path."""
    there = existing.select("out_path").distinct()
    return urls.join(there, "out_path", "left_anti"), urls.join(there, "out_path", "left_semi")


def resume_cache(manifest: DataFrame, scheduled: DataFrame | None = None, most: int = 0) -> DataFrame:
    """url, etag, last_modified, content_hash of each URL's first usable row if scheduled URLs are given, else of its last.

    manifest: url, etag, last_modified, content_hash, ordinal. A row is usable if it has any of the three."""
    usable = manifest.where(F.coalesce("etag", "last_modified", "content_hash").isNotNull() & (F.coalesce("url", F.lit("")) != ""))
    entry = F.struct("etag", "last_modified", "content_hash")
    if scheduled is not None:
        usable = usable.join(scheduled.select("url").distinct(), "url", "left_semi")
    pick = F.min_by if scheduled is not None else F.max_by
    out = usable.groupBy("url").agg(pick(entry, "ordinal").alias("e"), F.min("ordinal").alias("at")).select("url", "e.*", "at")
    return (out.orderBy("at").limit(most) if most > 0 else out).drop("at")


def ok_urls(manifest: DataFrame) -> DataFrame:
    return manifest.where("status = 'ok'").select("url").distinct()


def snapshot_quota(snapshots: DataFrame, most_files: int = 0, most_bytes: int = 0) -> DataFrame:
    """snapshots (run_id, ord, size, ...) that the quota of their run admits, in order.

    Admission depends on what was admitted before (a later, smaller one may still fit), so each run is one ordered fold. With a
    byte quota alone the fold keeps no more than sizes and places; without quotas nothing is folded."""
    if most_files <= 0 and most_bytes <= 0:
        return snapshots
    if most_bytes <= 0:
        return snapshots.withColumn("rank__", F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))).where(F.col("rank__") <= most_files).drop("rank__")
    files = most_files if most_files > 0 else 1 << 62

    def fold(rows):
        used, count, keep = 0, 0, []
        for size in rows["size"]:
            fits = count < files and used + size <= most_bytes
            keep.append(fits)
            used, count = used + size * fits, count + fits
        return rows[["run_id", "ord"]][keep]

    small = snapshots.select("run_id", "ord", "size")
    admitted = small.groupBy("run_id").applyInPandas(lambda rows: fold(rows.sort_values("ord")), "run_id string, ord bigint")
    return snapshots.join(admitted, ["run_id", "ord"], "left_semi")
