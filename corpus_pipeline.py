"""From raw documents to packed sequences: quality classifier, exact dedup, near dedup, packing.

Defined results, of all stages: a null text counts as empty (it is scored, its copies are one group, and the one that stays is a
sequence piece of the end id alone); rows that repeat a doc_id are different rows, and repeated rows are copies of each other; whole texts are
read, however long; an empty table gives an empty one; all stages but the last keep every column of documents as it is, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import written
from corpusloom.llm.exact_dedup import kept_documents
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import good_documents
from corpusloom.llm.simhash import without_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: those that score 0.3 or more. Without any usable label all stay."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: the one with the largest doc_id (a null one is the smallest), then the one with the largest locator."""
    return kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies (chains of texts whose five-word shingles are 0.8 alike or more): the one with the smallest doc_id (a null one
    is the largest), then the one with the smallest locator. Texts with the same words between other white space are copies, and so are all texts without words."""
    return without_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, in as few sequences of 1024 tokens as best fit finds."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("best-fit packing", packing)]

#: No SQL expresses the classifier's vectors, the fingerprints or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
