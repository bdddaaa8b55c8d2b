"""Helpers shared by the training-data operators: shared folders, row locators, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many rows x bytes; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session (tests) may do without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("corpusloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("corpusloom.shared.dir", found)
        atexit.register(_remove, spark, found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended: the folder then stays for whoever owns the shared folder
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the driver's process ends."""
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, uri)
    return uri


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut, and any executor may be lost after it."""
    spark = df.sparkSession
    uri = new_folder(spark, name)
    df.write.parquet(uri)
    table = spark.read.schema(df.schema).parquet(uri)
    table.corpusloom_folder = uri
    return table


def drop(*tables: DataFrame) -> None:
    """Remove the folders of written tables that nothing reads any more."""
    for table in tables:
        uri = getattr(table, "corpusloom_folder", None)
        if uri:
            _remove(table.sparkSession, uri)


def fresh(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores before it as it takes to differ from the taken ones."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def with_locator(df: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("file_key", "row_at")) -> DataFrame:
    """The given columns, and where each row stands: a hash of its file's path and its place in that file, under the names.

    Only rows of a file scan have a place. Other frames are first written to the shared folder, so that a place is the same however often a task is run."""
    kept = scanned(df)
    at = kept.metadataColumn("_metadata")
    return kept.select(*[kept[c] for c in columns], F.xxhash64(at["file_path"]).alias(names[0]), at["row_index"].alias(names[1]))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of the places in gone (file_key, row_at), with its columns as they were. docs is a file scan."""
    names = fresh("file_key", docs.columns), fresh("row_at", docs.columns)
    gone = written(gone.select("file_key", "row_at"), "gone")
    gone = small_or_not(gone.toDF(*names), gone.count(), 32)
    return with_locator(docs, docs.columns, names).join(gone, list(names), "left_anti").select(*docs.columns)


def scanned(df: DataFrame) -> DataFrame:
    """df itself if it is a file scan; else written to the shared folder and read, so that its rows have places."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018
        return df
    except Exception as e:
        if "metadata" not in str(e).lower() and "UNRESOLVED_COLUMN" not in str(e):
            raise
    return written(df, "rows")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_or_not(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast only if rows x row_bytes stays below the limit."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
