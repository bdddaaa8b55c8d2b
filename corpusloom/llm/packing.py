"""Vector best-fit packing (operator 2).

Documents are tokenised and, where longer than a sequence, cut into pieces; a bin (sequence) has three capacities: tokens,
documents and attention cost (sum of squared lengths). Pieces are dealt evenly over shards of bounded size by a hash of
their document, number and ids and the document's place in its file, so that a table packed twice gives the same sequences; within a shard, pieces go longest first to the feasible bin that scores best: the smallest weighted norm of what
remains, or the largest weighted dot product of demand and what remains. A whole piece of full length needs no search.

Defined results: a null text is empty (one piece, the end id); repeated rows are packed as often as they occur; pieces of one length go by
doc_id, number and ids, the largest first, and bins of one score by their age; whole texts are packed, however long; an empty table
gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, with_locator, written
from .tokenize import byte_bpe

#: Pieces in one shard: a task packs so many, in bounded memory. A shard wastes a bin or two at its end, one in ten thousand.
SHARD_PIECES = 40_000


def pieces_of(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of n tokens: only the first is shorter than size."""
    first = n % size or min(n, size)
    yield 0, first
    for start in range(first, n, size):
        yield start, size


def token_pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, and row_at: the document's place in its file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, row_at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                out += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes()), row_at) for i, (s, n) in enumerate(pieces_of(len(ids), size))]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32", "row_at"])

    located = with_locator(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "row_at", text_of().alias("text"))
    return located.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row_at bigint")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, score: str = "norm", weights: tuple = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Runs of one length are placed together: bins in order of score, each taking what all its capacities allow."""
    caps, w = np.array([tokens, documents, attention], float), np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    left = np.empty((0, 3), np.int64)  # what remains of each open bin
    names = np.empty(0, np.int64)  # its number
    opened, at = 0, 0
    values, counts = np.unique(-lengths, return_counts=True)
    for length, count in zip((-values).tolist(), counts.tolist(), strict=True):
        need = np.array([length, 1, length * length], np.int64)
        if length > tokens or need[2] > attention or documents < 1:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        here, at = order[at : at + count], at + count
        fits = np.flatnonzero((left >= need).all(axis=1))
        if len(fits):
            room = left[fits] / caps
            by = (w * (room - need / caps) ** 2).sum(axis=1) if score == "norm" else -(w * (need / caps) * room).sum(axis=1)
            fits = fits[np.argsort(by, kind="stable")]
            takes = (left[fits] // need).min(axis=1)
            takes = np.clip(count - np.concatenate([[0], np.cumsum(takes)[:-1]]), 0, takes)
            fits, takes = fits[takes > 0], takes[takes > 0]
            placed = int(takes.sum())
            bins[here[:placed]] = np.repeat(names[fits], takes)
            left[fits] -= takes[:, None] * need
            here = here[placed:]
        if len(here):
            each = int((np.array([tokens, documents, attention]) // need).min())
            new = -(-len(here) // each)
            takes = np.full(new, each)
            takes[-1] = len(here) - each * (new - 1)
            bins[here] = np.repeat(np.arange(opened, opened + new), takes)
            left = np.concatenate([left, np.array([[tokens, documents, attention]]) - takes[:, None] * need])
            names = np.concatenate([names, np.arange(opened, opened + new)])
            opened += new
        alive = (left[:, 0] > 0) & (left[:, 1] > 0) & (left[:, 2] > 0)
        left, names = left[alive], names[alive]
    by_bin = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[by_bin])
    starts = ends - lengths[by_bin]
    first = np.concatenate([[True], bins[by_bin][1:] != bins[by_bin][:-1]]) if len(bins) else np.empty(0, bool)
    offsets = np.empty(len(bins), np.int64)
    offsets[by_bin] = starts - np.maximum.accumulate(np.where(first, starts, 0)) if len(bins) else starts
    return bins, offsets


def pack(docs: DataFrame, path: str, end_id: int = 2, tokens: int = 1024, documents: int = 1024, attention: int = 1024 * 1024, score: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = written(token_pieces(docs, path, end_id, tokens), "pieces")
    parts = pieces.where(F.col("length") < tokens)
    shards = max(1, -(-parts.count() // SHARD_PIECES))
    placed_schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def place(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "row_at"], ascending=False, kind="stable")
        bins, offsets = best_fit(rows["length"].to_numpy(np.int64), tokens, documents, attention, score)
        return rows.drop(columns=["shard", "row_at"]).assign(sequence_id=(int(shard[0]) << 32) + bins, offset=offsets)

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row_at"), F.lit(shards)))
    some = dealt.groupBy("shard").applyInPandas(place, placed_schema)
    whole = pieces.where(F.col("length") == tokens).drop("row_at").select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return some.unionByName(whole)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
