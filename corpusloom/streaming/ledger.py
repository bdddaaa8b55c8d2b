"""Running counts of a manifest that grows: Structured Streaming over the ledger's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import summary
from ..schema import MANIFEST_SCHEMA


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MANIFEST_SCHEMA).parquet(folder)


def stream_summary(stream: DataFrame, checkpoint: str, table: str) -> None:
    """Take in all that is new and keep (dimension, key, count) as Parquet at table; the checkpoint carries the counts over to the next call."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    summary(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def new_urls(stream: DataFrame, checkpoint: str, table: str) -> None:
    """Each url once, appended to table: state without expiry, as a run must know all that was visited."""
    stream.select("url").where(F.col("url").isNotNull()).dropDuplicates(["url"]).writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
