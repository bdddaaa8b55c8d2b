"""Quality by nearest-neighbour voting in a latent-semantic space (operator 3).

A bounded sample of labelled documents gives a term matrix and by a truncated singular value decomposition a latent space. Terms are
the words as they stand, hashed, and how far back each word last stood (a power of two, or never); their shares are square-rooted and
weighted by inverse document frequency. The labelled vectors are broadcast; every document
is projected, its cosine with all of them is computed in exact blocks, and its nearest neighbours vote with their labels,
weighted by similarity and by how many labelled rows of the class each stands for.

Defined results: a null text counts as empty; a text without terms gets the share of label 1; without any usable label every
score is 1; repeated labels of a doc_id count once (the largest); a null doc_id is held out; an empty table gives no rows; repeated rows
get equal scores; of labelled documents with one doc_id all texts are learnt from, those of least hash first where the sample is full;
whole texts are read, however long; columns besides doc_id and text are not read by the model.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_of

WORDS, BACK = 4096, 24  # hashed words, and distances back to a word's last place
TERMS = WORDS + BACK
TOKEN = re.compile(r"\w+|[^\w\s]+")
BLOCK = 512  # documents in one product


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and square-rooted shares of one whole text: of all words, and of all distances."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts: dict[int, int] = {}
    crc, last, back = zlib.crc32, {}, [0] * BACK
    for token, n in Counter(tokens).items():
        term = crc(token.encode()) % WORDS
        counts[term] = counts.get(term, 0) + n
    for i, token in enumerate(tokens):
        back[min((i - last[token]).bit_length(), BACK - 1) if token in last else 0] += 1
        last[token] = i
    counts |= {WORDS + d: n for d, n in enumerate(back) if n}
    terms = np.fromiter(counts.keys(), np.int32, len(counts))
    return terms, np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / len(tokens))


@dataclass
class Model:
    project: np.ndarray  # terms x latent, weighted by inverse document frequency
    vectors: np.ndarray  # labelled documents x latent, of unit length
    votes: np.ndarray  # labelled documents x 2: weight for label 0 and label 1
    prior: float
    neighbours: int
    sharpness: int

    def latent(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for i, text in enumerate(texts):
            terms, shares = term_counts(text)
            if len(terms):
                out[i] = shares @ self.project[terms]
        return unit(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        k = min(self.neighbours, len(self.vectors))
        for i in range(0, len(texts) if k else 0, BLOCK):
            z = self.latent(texts[i : i + BLOCK])
            # Blocks are always full, so that a text's cosines don't depend on what it is multiplied with.
            near = (np.concatenate([z, np.zeros((BLOCK - len(z), z.shape[1]), np.float32)]) @ self.vectors.T)[: len(z)]
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(near, top, axis=1), 0, 1).astype(np.float64) ** self.sharpness
            for_, all_ = (weight * self.votes[top, 1]).sum(axis=1), (weight * self.votes[top].sum(axis=2)).sum(axis=1)
            out[i : i + BLOCK] = np.where(all_ > 1e-12, for_ / np.maximum(all_, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [term_counts(t) for t in rows["text"]]
        yield pd.DataFrame({"quality": rows["quality"], "doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "terms": [t for t, _ in found], "shares": [s for _, s in found]})


def latent_axes(x: np.ndarray, latent: int) -> np.ndarray:
    """The first right singular vectors of x as columns, by subspace iteration from a fixed start."""
    latent = min(latent, *x.shape)
    y = x @ np.random.default_rng(7).standard_normal((x.shape[1], min(latent + 16, x.shape[1]))).astype(np.float32)
    for _ in range(3):
        y = x @ np.linalg.qr(x.T @ np.linalg.qr(y)[0])[0]
    q = np.linalg.qr(y)[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:latent].T


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, latent: int = 64, neighbours: int = 15, sharpness: int = 16) -> Model:
    """Learns from at most per_class labelled documents of each label (those of least hash), none of them held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")))
    totals = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    sample = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # at most 2 x per_class rows
    joined = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").select("quality", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = joined.mapInPandas(_features, "quality int, doc_id bigint, text_hash bigint, terms array<int>, shares array<float>")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(2 * per_class).collect()
    if not rows:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros((0, 2)), 1.0, neighbours, sharpness)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["terms"]] = r["shares"]
    idf = np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    axes = latent_axes(x, latent)
    quality = np.array([r["quality"] for r in rows])
    counts = {c: max(1, int((quality == c).sum())) for c in (0, 1)}
    stands_for = np.array([totals.get(c, 0) / counts[c] for c in (0, 1)])
    votes = np.stack([(quality == c) * stands_for[c] for c in (0, 1)], axis=1)
    return Model(axes * idf[:, None], unit(x @ axes).astype(np.float32), votes, totals.get(1, 0) / max(1, sum(totals.values())), neighbours, sharpness)


def scored(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if none are named) and the score of each row's text; a column of the score's name gives way to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 x per_class vectors and the projection: a few MB
    fields = [docs.schema[c] for c in (keep if keep is not None else docs.columns) if c.lower() != name.lower()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(fields)
            texts = batch.column(n).to_pylist()
            scores = np.concatenate([shared.value.scores(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], names=[*[f.name for f in fields], name])

    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])
    return docs.select(*[F.col(f.name) for f in fields], text_of().alias("__text")).mapInArrow(of, schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those scored below the threshold, with its columns as they were."""
    name = fresh("score", docs.columns)
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= threshold).select(*docs.columns)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model, "score", ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
