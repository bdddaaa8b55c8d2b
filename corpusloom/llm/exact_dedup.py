"""Exact deduplication by a stateful stream (operator 1). DataFrame and SQL functions only.

The state is a RocksDB store keyed by the SHA-256 digest of a text; it never expires and keeps, for each digest, how many
rows have it and the largest (doc_id, content locator). A digest that several rows share is a hit; for hits the full bytes
are compared with those of the row that stays, and rows that share a digest but not the bytes are parted by the bytes.

Defined results: a null text counts as empty; null doc_ids sort below all others; of rows that repeat doc_id and text, the one
with the largest locator stays; whole texts are compared, however long; an empty table gives an empty result; columns besides doc_id
and text are not read. A locator is a hash of the file's path and the row's place in it: rows are told apart up to a 64-bit collision of
two paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, scanned, small_or_not, text_of, with_locator, without_rows, written

#: Rows of a group of equal digests that one task compares.
SALT_ROWS = 128
#: Groups of more rows are joined with their winner by a broadcast, where that is small.
HOT_ROWS = 100_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # an open store holds 4 MB of disk, however few its keys
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DedupStore:
    """Digests seen so far, in a folder that all executors share. Ingesting more rows later updates the same state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def ingest(self, keys: DataFrame) -> None:
        """keys: a stream of digest, doc_id, file_key, row_at. Returns when all that is available has been taken in."""
        state = keys.groupBy("digest").agg(F.max(F.struct("doc_id", "file_key", "row_at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        folder = self.folder

        def save(batch: DataFrame, number: int) -> None:  # overwriting makes a repeated batch harmless
            batch.write.mode("overwrite").parquet(f"{folder}/winners/batch={number}")

        before = {k: self.spark.conf.get(k, None) for k in STATE_CONF}
        try:
            for k, v in STATE_CONF.items():
                self.spark.conf.set(k, v)
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def winners(self) -> DataFrame:
        """The newest state of each digest: digest, keep, group_size. Counts only grow, so the largest is the newest."""
        schema = "digest binary, keep struct<doc_id:bigint,file_key:bigint,row_at:bigint>, group_size bigint, batch bigint"
        seen = self.spark.read.schema(schema).parquet(f"{self.folder}/winners")
        return seen.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("s")).select("digest", "s.keep", "s.group_size")


def _in_files(docs: DataFrame, folder: str) -> DataFrame:
    """docs as a file scan, after its files have been noted in the store; frames that aren't of files are kept there."""
    spark = docs.sparkSession
    if scanned(docs) is not docs or not docs.inputFiles():
        where = f"{folder}/texts-{uuid.uuid4().hex}"
        docs.select("doc_id", "text").write.parquet(where)
        docs = spark.read.schema(docs.select("doc_id", "text").schema).parquet(where)
    spark.createDataFrame([(f,) for f in docs.inputFiles()], "value string").coalesce(1).write.mode("append").text(f"{folder}/files")
    return docs


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and text of all files noted in the store."""
    files = [r["value"] for r in spark.read.text(f"{folder}/files").collect()]
    return spark.read.schema("doc_id bigint, text string").parquet(*files) if files else spark.createDataFrame([], "doc_id bigint, text string")


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = with_locator(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), "file_key", "row_at")
    return rows.withColumn("digest", digest(F.col("text")))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000, store: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, file_key, row_at (its locator).

    With a store, a folder that outlives the run, docs are taken in after all that was taken in there before, and the rows are those of all
    documents so far: only the new ones are hashed and pass through the state, and hits are compared with the bytes of earlier files, which must still be there."""
    spark = docs.sparkSession
    folder = store or new_folder(spark, "dedup")
    docs = scanned(docs) if store is None else _in_files(docs, folder)
    _keyed(docs, digest).select("digest", "doc_id", "file_key", "row_at").write.mode("append").parquet(f"{folder}/keys")
    keyed = _keyed(docs, digest) if store is None else _keyed(_sources(spark, folder), digest)
    keys = spark.read.schema("digest binary, doc_id bigint, file_key bigint, row_at bigint").parquet(f"{folder}/keys")
    store = DedupStore(spark, folder)
    store.ingest(spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/keys"))
    if keys.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string, file_key bigint, row_at bigint")
    winners = written(store.winners(), "winners")

    # Hits: full bytes against the bytes of the row that stays.
    shared = winners.where("group_size > 1").select("digest", "keep", F.ceil(F.col("group_size") / SALT_ROWS).cast("int").alias("salts"))
    hits = keyed.join(small_or_not(shared, shared.count(), 90), "digest")
    is_keeper = (F.col("file_key") == F.col("keep.file_key")) & (F.col("row_at") == F.col("keep.row_at"))
    # A large group is dealt out by salts, each with its own copy of the text that stays.
    keepers = hits.where(is_keeper).select("digest", F.col("text").alias("keep_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = hits.where(~is_keeper).select("digest", "text", F.pmod(F.xxhash64("file_key", "row_at"), F.col("salts")).cast("int").alias("salt"))
    differing = written(others.join(keepers, ["digest", "salt"]).where("text <> keep_text").select("digest").distinct(), "differing")

    found = _with_winners(keys, winners)
    if not differing.isEmpty():  # one digest, several texts: part those groups by their bytes
        again = keyed.join(differing, "digest").select("digest", "text", "doc_id", "file_key", "row_at")
        own = again.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file_key", "row_at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        parted = again.join(own, ["digest", "text"]).select("digest", "doc_id", "file_key", "row_at", "keep", "group_size")
        found = found.join(differing, "digest", "left_anti").unionByName(parted)
    return found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        is_keeper.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "file_key",
        "row_at",
    )


def _with_winners(keys: DataFrame, winners: DataFrame) -> DataFrame:
    """keys joined with winners; digests of very many rows (at most one in HOT_ROWS rows) are joined by a small side, so that no task gets all of one."""
    hot = winners.where(F.col("group_size") > HOT_ROWS)
    n = hot.count()
    if not n:
        return keys.join(winners, "digest")
    side = small_or_not(hot, n, 100)
    return keys.join(side, "digest").unionByName(keys.join(side.select("digest"), "digest", "left_anti").join(winners.where(F.col("group_size") <= HOT_ROWS), "digest"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without its exact copies, with its columns as they were."""
    docs = scanned(docs)
    return without_rows(docs, exact_dedup(docs).where("not kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
