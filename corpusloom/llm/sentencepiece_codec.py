"""SentencePiece encoding and decoding by a table of distinct chunks (operator 7).

Where no piece holds the white-space mark after another character, no piece crosses from one marked word to the next. A text is
then cut before each run of marks; each distinct chunk is segmented once for the table of its worker, and ids are joined back by
position. Models with other pieces or another normalizer are run on whole texts.

Defined results: a null or empty text has the begin and end ids alone; repeated rows and ids come out as often as they occur, each with
its own text's ids; whole texts are encoded, however long, in blocks of rows; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks in a worker's table; then it starts anew, which changes no ids.
TABLE = 400_000


@functools.lru_cache(maxsize=2)
def codec(path: str) -> tuple[Callable[[str], bytes], Callable[[list[int]], str]]:
    """encode (ids as little-endian 32-bit integers, with begin and end ids) and decode."""
    from sentencepiece import sentencepiece_model_pb2

    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(whole.serialized_model_proto())
    spec = model.normalizer_spec
    crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces) or any(p.type == p.USER_DEFINED for p in model.pieces)
    if crossing or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
        return lambda text: np.array(whole.encode(text, add_bos=True, add_eos=True), "<u4").tobytes(), whole.decode
    spec.add_dummy_prefix = False
    of_chunks = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    begin, end = (i.to_bytes(4, "little") for i in (whole.bos_id(), whole.eos_id()))
    table: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        if not text:
            return begin + end
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        if len(table) > TABLE:
            table.clear()
        new = [c for c in dict.fromkeys(chunks) if c not in table]
        for chunk, ids in zip(new, of_chunks.encode(new, num_threads=1), strict=True):
            table[chunk] = np.array(ids, "<u4").tobytes()
        return b"".join([begin, *map(table.__getitem__, chunks), end])

    return encode, whole.decode


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers) and decoded text of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(of, "doc_id bigint, ids binary, decoded string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = coded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
