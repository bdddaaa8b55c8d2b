import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from corpusloom.llm import quality
from corpusloom.llm import simhash as S
from tokenizers import Tokenizer

from .conftest import EDGE
from .test_dedup import brute_similar


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    good = {i for i, s in zip(ids, model.scores([texts[i] for i in ids]), strict=True) if s >= 0.3}
    first = cp.quality(spark, docs, sf_dir)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == good
    kept = {max(i for i in good if texts[i] == t) for t in {texts[i] for i in good}}
    second = cp.exact(spark, first, sf_dir)
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == kept
    third = cp.near(spark, second, sf_dir)
    left = {r["doc_id"] for r in third.collect()}
    assert third.columns == docs.columns and left <= kept
    # Of each group that shingles of 0.8 or more join, at least one stays, and whatever goes has its group's first one left.
    order = sorted(kept)
    label = brute_similar([texts[i] for i in order])
    groups = {}
    for i, k in zip(order, label, strict=True):
        groups.setdefault(k, []).append(i)
    assert all(set(g) & left for g in groups.values())
    pairs = [g for g in groups.values() if len(g) > 1]
    assert sum(len(set(g) & left) == 1 for g in pairs) >= 0.97 * len(pairs) and kept - left == {i for g in pairs for i in g} - left
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i in sorted(left):
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    packed = cp.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert len(cp.STAGES) == 4


@pytest.mark.parametrize("source", ["edge", "memory_edge", "nothing"])
def test_pipeline_on_edges(spark, request, tmp_path, source):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, empty tables: every stage keeps the columns, and what it keeps is defined."""
    docs = request.getfixturevalue(source)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, texts = docs, [t or "" for _, t in EDGE] if source != "nothing" else []
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    left = [r["text"] or "" for r in now.collect()]
    words = lambda t: tuple(t.encode().lower().split())
    assert sorted(map(words, left)) == sorted({words(t) for t in texts})  # of texts with the same words one stays; no two of the others are alike
    packed = cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert len({(r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in packed}) >= len(left) and len(packed) >= len(left)


def test_near_stage_and_texts_without_words(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "a b"), (5, "a  b"), (6, "a c")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in S.without_near_copies(rows).collect()) == [1, 4, 6]
