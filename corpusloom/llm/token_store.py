"""Token ids in raw shards with a minimal perfect hash index (operator 10).

Documents are dealt out by ranges of doc_id, in ascending order. A task writes one shard: nothing but the ids of its documents,
little-endian, of two bytes where the vocabulary allows, one document after the other. The index maps a document's key to
(shard, first id, number of ids): keys are dealt to buckets of bounded size by their hash, and each bucket has a minimal perfect
hash (levels of bit arrays with ranks) whose slots hold a fingerprint of the key, so that a lookup takes constant time and
keys that were never stored are told apart. Files appear under their names only when whole, and a shard's name tells the attempt that
wrote it: only those that the committed places name are read, so tasks may run again or twice at once.

Defined results: a null text is the end id alone; rows that repeat a doc_id are stored one after the other, by their place in the table, as
copies 0, 1, ... of the key, however many shards they fill, and a null doc_id sorts first; whole texts are stored, however long; an
empty table gives no shards and no rows; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, text_of, with_locator, written
from .tokenize import word_bpe

BUCKET_KEYS = 250_000
SHARD_BYTES = 128 << 20  # of text in a shard, on average at most
NO_ID = -(1 << 63)  # stands for a null doc_id


# -- Files in a shared folder -------------------------------------------------------------------------------------------------


#: Schemes of Hadoop's file systems, and what Arrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "abfss": "abfs", "viewfs": "viewfs"}


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return (parts.path or uri) if parts.scheme in ("", "file") else None


def arrow_uri(uri: str) -> str:
    """The URI with its scheme as Arrow's file systems know it."""
    scheme, found, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else uri


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def put(uri: str, chunks: Iterator[bytes]) -> None:
    """Write a file that appears under its name once it is whole."""
    path, mark = _local(uri), uuid.uuid4().hex
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{mark}"
        with open(temporary, "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(temporary, path)
        return
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{mark}"
    with store.open_output_stream(temporary) as f:
        for c in chunks:
            f.write(c)
    store.move(temporary, path)


def opened(uri: str):
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    store, path = _store(uri)
    return store.open_input_file(path)


def mapped(uri: str) -> np.ndarray:
    """The file's bytes: of a mounted file only the pages that are looked at are read."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, np.uint8, "r")
    with opened(uri) as f:
        return np.frombuffer(f.read(), np.uint8)


# -- Minimal perfect hash -------------------------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each key (unsigned 64-bit), another for each salt."""
    h = keys + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def key_of(doc_ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """One 64-bit key for (doc_id, copy); copy 0 is a bijection of doc_id, so that distinct documents never share a key."""
    keys = mixed(doc_ids.astype(np.int64).view(np.uint64), 0)
    return np.where(copies == 0, keys, mixed(keys ^ mixed(copies.astype(np.uint64), 1), 2))


class PerfectHash:
    """Levels of bit arrays: a key's bit is set on the first level where no other key has it; its slot is the rank of that bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # one boolean array each
        self.before = np.cumsum([0, *[int(b.sum()) for b in levels]])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.7) -> PerfectHash:
        left, levels = np.unique(keys), []
        if len(left) != len(keys):
            raise ValueError("keys repeat")
        while len(left):
            if len(levels) == 200:
                raise ValueError("no perfect hash found")
            size = max(2, int(len(left) * room))
            at = (mixed(left, 3 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that isn't stored, any slot or -1."""
        out = np.full(len(keys), -1)
        for i, bits in enumerate(self.levels):
            todo = np.flatnonzero(out < 0)
            if not len(todo):
                break
            at = (mixed(keys[todo], 3 + i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.before[i] + self.ranks[i][at[hit]]
        return out


SLOT = np.dtype([("print", "<u4"), ("shard", "<i4"), ("first", "<i8"), ("n", "<i8")])
RANKED = 512  # bits between two stored ranks


def prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def dump_index(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
    """Head, then of each level its bits and how many are set before every RANKED of them, then the slots."""
    hash_ = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = hash_.slots(keys)
    for name, values in (("print", prints(keys)), ("shard", shard), ("first", first), ("n", n)):
        slots[name][at] = values
    head = json.dumps({"levels": [len(b) for b in hash_.levels], "keys": len(keys)}).encode()
    yield struct.pack("<I", len(head)) + head
    for bits in hash_.levels:
        whole = np.append(bits, np.zeros(-len(bits) % RANKED, bool))
        yield np.packbits(whole).tobytes()
        yield np.append(0, np.cumsum(whole.reshape(-1, RANKED).sum(axis=1))).astype("<u4").tobytes()
    yield slots.tobytes()


class Index:
    """One bucket of the index in its file. A lookup reads a block of bits and a rank on each level down to its own, and one slot: its time doesn't grow with
    the bucket."""

    def __init__(self, uri: str):
        raw = mapped(uri)
        (size,) = struct.unpack("<I", raw[:4].tobytes())
        head, at = json.loads(raw[4 : 4 + size].tobytes()), 4 + size
        self.levels, self.before, below = [], [], 0
        for bits in head["levels"]:
            blocks = -(-bits // RANKED)
            end = at + blocks * RANKED // 8
            ranks = np.frombuffer(raw[end : end + 4 * (blocks + 1)], "<u4")
            self.levels.append((bits, raw[at:end].reshape(blocks, RANKED // 8), ranks))
            self.before.append(below)
            below, at = below + int(ranks[-1]), end + 4 * (blocks + 1)
        self.slots = np.frombuffer(raw[at : at + SLOT.itemsize * head["keys"]], SLOT)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that isn't stored, any slot or -1."""
        out = np.full(len(keys), -1)
        for i, (bits, blocks, ranks) in enumerate(self.levels):
            todo = np.flatnonzero(out < 0)
            if not len(todo):
                break
            at = (mixed(keys[todo], 3 + i) % np.uint64(bits)).astype(np.int64)
            hit = (blocks[at // RANKED, at % RANKED // 8] >> (7 - at % 8).astype(np.uint8)) & 1 == 1
            at, todo = at[hit], todo[hit]
            inside = np.unpackbits(blocks[at // RANKED], axis=1)
            out[todo] = self.before[i] + ranks[at // RANKED] + (inside * (np.arange(RANKED) < (at % RANKED)[:, None])).sum(axis=1)
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot records, whether each key is stored)."""
        at = np.concatenate([self.places(keys[i : i + 4096]) for i in range(0, len(keys), 4096)] or [np.empty(0, np.int64)])
        found = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(keys), SLOT)
        return found, (at >= 0) & (found["print"] == prints(keys)) & (len(self.slots) > 0)


# -- Writing and reading ----------------------------------------------------------------------------------------------------------


def _keys(doc_id: pd.Series, copy: pd.Series) -> np.ndarray:
    return key_of(doc_id.fillna(NO_ID).astype("int64").to_numpy(), copy.to_numpy(np.int64))


class TokenStore:
    """Token ids of a corpus in one folder: shards, an index in buckets, and what a reader must know (manifest.json)."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict):
        self.spark, self.folder, self.manifest = spark, folder, manifest

    @classmethod
    def write(cls, docs: DataFrame, folder: str, path: str, end_id: int = 1) -> TokenStore:
        spark = docs.sparkSession
        from tokenizers import Tokenizer

        width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Writes the partition's shard, under a name of this attempt, and hands on where each document stands in it."""
            context = TaskContext.get()
            encode, shard, rows = word_bpe(path), context.partitionId(), []
            name = f"{shard:06d}-{context.taskAttemptId():x}"

            def payload() -> Iterator[bytes]:
                first, last, copy = 0, None, 0
                for batch in batches:
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        ids = np.append(np.frombuffer(encode(text), "<u4"), np.uint32(end_id))
                        own = NO_ID if doc_id is None else doc_id
                        copy = copy + 1 if rows and own == last else 0
                        rows.append((doc_id, copy, shard, first, len(ids)))
                        first, last = first + len(ids), own
                        yield ids.astype(f"<u{width}").tobytes()

            chunks = payload()
            head = next(chunks, None)
            if head is None:
                return
            put(f"{folder}/shards/{name}.ids", (c for part in ([head], chunks) for c in part))
            for i in range(0, len(rows), 50_000):
                d, c, s, f, n = zip(*rows[i : i + 50_000], strict=True)
                columns = [pa.array(x, t) for x, t in ((d, pa.int64()), (c, pa.int64()), (s, pa.int32()), (f, pa.int64()), (n, pa.int64()), ([name] * len(d), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "shard", "first", "n", "name"])

        # Rows of one doc_id go by their place in the table, so that a task that runs again finds them in the same order; many of them may fill several shards.
        located = with_locator(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), "file_key", "row_at")
        size = located.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
        n, order = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES)), ["doc_id", "file_key", "row_at"]
        ordered = located.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
        where = written(ordered.mapInArrow(save, "doc_id bigint, copy bigint, shard int, first bigint, n bigint, name string"), "places")
        own = F.coalesce("doc_id", F.lit(NO_ID))
        parts = sorted(where.groupBy("shard", "name").agg(F.sum("n").alias("ids"), F.min(own).alias("least"), F.max(own).alias("most")).collect())  # a row per shard
        starts, names, total = {}, {}, 0
        for r in parts:
            starts[r["shard"]], names[r["shard"]], total = total, r["name"], total + r["ids"]
        # A doc_id that goes on from one shard to the next: its copies there are numbered after those before. At most one for each shard.
        across = {b["least"] for a, b in zip(parts, parts[1:], strict=False) if a["most"] == b["least"]}
        if across:
            counts, offsets, done = where.where(own.isin(list(across))).groupBy(own.alias("own"), "shard").count().orderBy("own", "shard").collect(), [], {}
            for r in counts:
                offsets.append((r["own"], r["shard"], done.get(r["own"], 0)))
                done[r["own"]] = done.get(r["own"], 0) + r["count"]
            side = F.broadcast(spark.createDataFrame(offsets, "own bigint, in_shard int, earlier bigint"))
            joined = where.join(side, (own == F.col("own")) & (F.col("shard") == F.col("in_shard")), "left")
            where = joined.select("doc_id", (F.col("copy") + F.coalesce("earlier", F.lit(0))).alias("copy"), "shard", "first", "n", "name")
        buckets = max(1, -(-where.count() // BUCKET_KEYS))

        def index(rows: pd.DataFrame) -> pd.DataFrame:
            keys = _keys(rows["doc_id"], rows["copy"])
            bucket = int(rows["bucket"].iloc[0])
            put(f"{folder}/index/{bucket:06d}.mph", dump_index(keys, rows["shard"].to_numpy(), rows["first"].to_numpy(), rows["n"].to_numpy()))
            return pd.DataFrame({"bucket": [bucket], "keys": [len(keys)]})

        made = cls._dealt(where, buckets).groupBy("bucket").applyInPandas(index, "bucket int, keys bigint").agg(F.sum("keys")).first()[0]
        manifest = {"width": width, "buckets": buckets, "documents": made or 0, "ids": total, "starts": {str(k): v for k, v in starts.items()}, "names": {str(k): v for k, v in names.items()}}
        put(f"{folder}/manifest.json", iter([json.dumps(manifest).encode()]))
        store = cls(spark, folder, manifest)
        store.places = where
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenStore:
        with opened(f"{folder}/manifest.json") as f:
            return cls(spark, folder, json.loads(f.read()))

    @staticmethod
    def _dealt(keys: DataFrame, buckets: int) -> DataFrame:
        return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys: doc_id, copy. Where the index has them: doc_id, copy, shard, first, n; keys that aren't stored are left out."""
        folder, n = self.folder, int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: tuple[int, Index] | None = None
            for rows in batches:
                for bucket, part in rows.groupby("bucket", sort=False):
                    if held is None or held[0] != bucket:
                        held = (bucket, Index(f"{folder}/index/{int(bucket):06d}.mph"))
                    found, there = held[1].find(_keys(part["doc_id"], part["copy"]))
                    part, found = part[there], found[there]
                    yield part[["doc_id", "copy"]].assign(shard=found["shard"], first=found["first"], n=found["n"])

        dealt = self._dealt(keys.select("doc_id", "copy"), self.manifest["buckets"]).repartition(n, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInPandas(find, "doc_id bigint, copy bigint, shard int, first bigint, n bigint")

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, copy, start (ids of all documents before it), ids (little-endian 32-bit) of the stored keys."""
        folder, width, starts, names = self.folder, self.manifest["width"], self.manifest["starts"], self.manifest["names"]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, file = None, None
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    out, at = [], []
                    for shard, first, count in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                        if held != shard:
                            if file:
                                file.close()
                            held, file = shard, opened(f"{folder}/shards/{names[str(shard)]}.ids")
                        file.seek(first * width)
                        out.append(np.frombuffer(file.read(count * width), f"<u{width}").astype("<u4").tobytes())
                        at.append(starts[str(shard)] + first)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "copy", "start", "ids"])
            if file:
                file.close()

        places = self.lookup(keys).repartition(n, "shard").sortWithinPartitions("shard", "first")
        return places.mapInArrow(fetch, "doc_id bigint, copy bigint, start bigint, ids binary")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = TokenStore.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    found = store.read(store.places.select("doc_id", "copy"))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
