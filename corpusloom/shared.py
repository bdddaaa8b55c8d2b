"""Folders that driver and executors share, for tables that cut lineage or that several branches read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local session may do without that setting. It goes when the driver ends."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    folder = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended
        pass


def written(df: DataFrame, folder: str) -> DataFrame:
    """df as a Parquet table in the folder, read back."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
