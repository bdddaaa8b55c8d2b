"""The manifest ledger: reading JSON lines tolerantly, appending runs, writing derived files."""

from __future__ import annotations

import html
import json
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INDEX_COLUMNS, MANIFEST_SCHEMA, valid_row


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines ledger; blank and malformed lines and what isn't an object are skipped, missing fields are null.

    ordinal orders rows as they stand in their file (files by name)."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in MANIFEST_SCHEMA])
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("ordinal"))
    parsed = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", loose).alias("r"), "ordinal", F.try_parse_json("value").alias("ok"))
    return parsed.where("ok is not null and r.url is not null").select("r.*", "ordinal")


def append(manifest: DataFrame, folder: str) -> None:
    """Add a run: one folder per run_id; rows without their required strings are dropped."""
    manifest.where(valid_row()).write.mode("append").partitionBy("run_id").parquet(folder)


def overwrite_sorted(manifest: DataFrame, folder: str) -> None:
    """The sorted ledger replaces earlier runs; the sort spills like any other."""
    manifest.where(valid_row()).orderBy("url").write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(folder)


def index(manifest: DataFrame, by_url: bool = False) -> DataFrame:
    return manifest.select(*INDEX_COLUMNS).orderBy("url") if by_url else manifest.select(*INDEX_COLUMNS)


def save_atomically(path: str, text: str | Iterable[str]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines([text] if isinstance(text, str) else text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_files(files: DataFrame) -> DataFrame:
    """Write each row's text to its path (columns path, text), on a file system that all executors share; gives path and error (null if written)."""
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])

    def task(batches):
        import pandas as pd

        for rows in batches:
            errors = []
            for path, text in zip(rows["path"], rows["text"], strict=True):
                try:
                    save_atomically(path, text)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"path": rows["path"], "error": errors})

    return files.select("path", "text").mapInPandas(task, out)


def write_report_json(path: str, report: dict) -> None:
    save_atomically(path, json.dumps(report, indent=2, ensure_ascii=False))


def write_lines(path: str, lines: Iterable[str]) -> None:
    save_atomically(path, (f"{line}\n" for line in lines))


def report_html(summary: dict[str, list[Row]], failures: Iterable[Row], title: str = "Corpus report") -> Iterator[str]:
    """A page of bar charts (dimension -> rows of key, count, px) and the table of all pages that aren't ok, in pieces; everything is escaped."""
    esc = lambda v: html.escape("" if v is None else str(v), quote=True)
    yield f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1>"
    for d, rows in summary.items():
        yield f"<h2>{esc(d)}</h2>" + "".join(f'<div>{esc(r["key"])} <span style="display:inline-block;background:#58a;height:1em;width:{int(r["px"])}px"></span> {r["count"]}</div>' for r in rows)
    columns = ["url", "status", "http_status", "note", "error_kind", "error"]
    yield f"<h2>failures</h2><table><tr>{''.join(f'<th>{c}</th>' for c in columns)}</tr>"
    for r in failures:
        yield "<tr>" + "".join(f"<td>{esc(r[c])}</td>" for c in columns) + "</tr>"
    yield "</table>"
