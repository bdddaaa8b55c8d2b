"""Command line: one run over captured responses. URLs come from a table, or else are discovered in captured payloads (llms.txt, sitemaps, search
indexes), or else by a crawl over the captured pages. Exit codes: 0 done, 1 fatal, 2 no URLs, 130 interrupted."""

from __future__ import annotations

import datetime
import logging
import os
import shutil
import sys
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig, from_args, parser
from .functions import urls as U
from .operators.urls import resume_cache
from .plans import pipeline, views
from .plans.crawl import crawl
from .schema import FETCH_SCHEMA
from .sources import discovery as DI
from .sources import manifest as M

LOG = logging.getLogger("corpusloom")


PAYLOADS = "url string, status int, content_type string, body binary"


def crawled(responses: DataFrame, config: RunConfig, folder: str, robots: str | None) -> DataFrame:
    """url of every captured page that a crawl from the base reaches."""
    pages = responses.select("url", F.col("html_status").alias("status"), F.col("html_content_type").alias("content_type"), F.col("html_body").alias("html"))
    return crawl(pages, config, folder, robots)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    config = from_args(args)
    report_dir = config.report_dir or os.path.join(config.output_dir, "_report")
    scratch = os.path.abspath(os.path.join(report_dir, f"_work-{uuid.uuid4().hex}"))
    try:
        spark = SparkSession.builder.appName("corpusloom").getOrCreate()
        responses = spark.read.schema(FETCH_SCHEMA).parquet(args.responses) if args.responses else spark.createDataFrame([], FETCH_SCHEMA)
        payloads = spark.read.schema(PAYLOADS).parquet(args.payloads) if args.payloads else spark.createDataFrame([], PAYLOADS)
        robots = None if config.ignore_robots else DI.robots_text(payloads, config.base_url)
        found = ("sitemap", spark.read.parquet(args.urls)) if args.urls else DI.discover(payloads, config.base_url, lambda: crawled(responses, config, f"{scratch}/crawl", robots), config.max_body_bytes)
        source, urls = found
        kept, records = pipeline.plan_urls(urls, config, source)
        if kept.isEmpty() and all(r.isEmpty() for r in records):
            LOG.error("no URLs found")
            return 2
        M.write_lines(os.path.join(report_dir, "urls.txt"), (r["url"] for r in kept.select("url").orderBy("url").toLocalIterator()))
        if config.dry_run:
            LOG.info("%d URLs by %s", kept.count(), source)
            pipeline.schedule(kept, config, robots).orderBy("start", "url").write.mode("overwrite").json(os.path.join(report_dir, "schedule"))
            for r in DI.llms_full(payloads, config.base_url).collect():
                LOG.info("llms-full.txt at %s isn't used for pages", r["url"])
            return 0
        ledger, started, run_id = os.path.join(report_dir, "manifest"), datetime.datetime.now(datetime.UTC), uuid.uuid4().hex[:12]
        cache = None
        if config.resume and os.path.isdir(ledger):
            known = M.read(spark, ledger).withColumn("ordinal", F.monotonically_increasing_id())
            cache = resume_cache(known, kept, config.manifest_cache_max_entries)
        existing = None
        if config.skip_existing:
            files = [os.path.join(d, f) for d, _, files in os.walk(config.output_dir) for f in files]
            existing = spark.createDataFrame([(f,) for f in files], "out_path string")
        run = pipeline.run(urls, responses, replace(config, report_dir=report_dir), source, robots, existing, cache, run_id, f"{scratch}/run", started.isoformat())
        rows = run.manifest.persist()
        (M.overwrite_sorted if config.manifest_sorted else M.append)(rows.drop("stage_ord"), ledger)
        files = run.bodies.select(F.col("out_path").alias("path"), F.col("body").alias("text")).unionByName(run.html).unionByName(run.snapshots)
        failed = M.write_files(files).where("error is not null").count()
        counts = views.with_bars(views.summary(rows)).persist()
        maps: dict[str, dict[str, int]] = {}
        for r in counts.collect():  # as many rows as there are kinds of outcomes
            maps.setdefault(r["dimension"], {})[r["key"]] = r["count"]
        scalars = {**views.report_scalars(rows).first().asDict(), **views.plan_scalars(rows).first().asDict(), **views.count_maps(maps)}
        M.write_report_json(os.path.join(report_dir, "report.json"), {"run_id": run_id, "started_at_utc": started.isoformat(), "discovery_source": source, "scope_prefix": config.scope_prefix or "", **scalars, "write_errors": failed})
        whole = M.read(spark, ledger).withColumn("out_path", U.relative_to(F.col("out_path"), config.output_dir))
        lines = views.toc(whole.where("status = 'ok' and out_path is not null").select(F.col("out_path").alias("path"))).orderBy("parts")
        M.write_lines(os.path.join(report_dir, "toc.md"), (r["line"] for r in lines.toLocalIterator()))
        M.index(whole, config.manifest_sorted).write.mode("overwrite").json(os.path.join(report_dir, "index"))
        charts = {d: views.top_n(counts, d, 6 if d == "extractor" else 5).collect() for d in ("status", "http_status", "note", "error_kind", "extractor")}
        M.save_atomically(os.path.join(report_dir, "report.html"), M.report_html(charts, views.failures(whole).toLocalIterator()))
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception:
        LOG.exception("run failed")
        return 1
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    sys.exit(main())
