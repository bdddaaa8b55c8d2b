"""Views derived from the manifest: summary counts, top-n, bars, table of contents, report scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import content_type_name


def summary(manifest: DataFrame) -> DataFrame:
    """dimension, key, count in one pass: each row is unpivoted to its dimensions, then one aggregation with map-side combine."""
    none = F.lit("none")
    error = F.when(F.coalesce("error", F.lit("")) != "", "errors")
    cells = {"status": F.col("status"), "http_status": F.coalesce(F.col("http_status").cast("string"), none), "content_type": content_type_name(F.col("content_type")), "note": F.col("note"), "error_kind": F.col("error_kind"), "extractor": F.coalesce("extractor", none), "error": error}
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("key")) for d, c in cells.items()])
    return manifest.select(F.explode(pairs).alias("p")).where("p.key is not null").groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("count"))


def with_bars(counts: DataFrame, width: int = 240) -> DataFrame:
    """Adds px: each count scaled to the largest of its dimension. Counts are few, whatever the manifest's size."""
    most = F.max("count").over(Window.partitionBy("dimension"))
    return counts.withColumn("px", F.floor(F.col("count") * width / most).cast("int"))


def top_n(counts: DataFrame, dimension: str, n: int = 5) -> DataFrame:
    """The n largest counts of a dimension; ties go by key."""
    return counts.where(F.col("dimension") == dimension).orderBy(F.desc("count"), "key").limit(n)


def failures(manifest: DataFrame) -> DataFrame:
    return manifest.where("status <> 'ok'")


def report_scalars(manifest: DataFrame) -> DataFrame:
    """One row: total, ok, failed, skipped, and how many were limited or lost to path collisions."""
    n = lambda c: F.count_if(c).alias
    return manifest.agg(
        F.count(F.lit(1)).alias("total"),
        n(F.col("status") == "ok")("ok"),
        n(F.col("status") == "failed")("failed"),
        n(F.col("status") == "skipped")("skipped"),
        n(F.coalesce(F.col("note") == "path_collision", F.lit(False)))("path_collisions"),
        n(F.coalesce(F.col("note") == "max_pages_limit", F.lit(False)))("limited_urls"),
    )


def count_maps(counts: dict[str, dict[str, int]]) -> dict:
    """The count maps of a report, keys sorted, from dimension -> key -> count."""
    named = {f"{d}_counts": dict(sorted(counts.get(d, {}).items())) for d in ("status", "http_status", "content_type", "note", "error_kind", "extractor")}
    return {**named, "error_count": counts.get("error", {}).get("errors", 0)}


def plan_scalars(manifest: DataFrame) -> DataFrame:
    """One row: filtered_urls (after filters, collisions, limit and robots) and scheduled_urls (those left to fetch), from a run's manifest with stage_ord."""
    return manifest.agg(F.count_if(F.col("stage_ord") >= 4).alias("filtered_urls"), F.count_if(F.col("stage_ord") >= 5).alias("scheduled_urls"))


def toc(paths: DataFrame) -> DataFrame:
    """parts, line of each folder and file on the way to the paths (column path, relative): every prefix once, indented by depth.

    Ordered by parts, the lines are the bullets of the table of contents."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    prefixes = paths.select(parts.alias("all")).where(F.size("all") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("all")), lambda n: F.slice("all", 1, n))).alias("parts")).distinct()
    return prefixes.select("parts", F.concat(F.repeat(F.lit("  "), F.size("parts") - 1), F.lit("- "), F.element_at("parts", -1)).alias("line"))
