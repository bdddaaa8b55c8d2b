import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup as X
from corpusloom.llm import gray_index as G
from corpusloom.llm import simhash as S
from corpusloom.llm.components import components

from ..oracle import same
from .conftest import EDGE


def test_op1_against_sql(spark, sf_dir):
    same(spark, sf_dir, X.op1_exact_dedup, X.OP1_SQL)


@pytest.mark.parametrize("source", ["edge", "memory_edge"])
def test_op1_edges(request, source):
    rows = X.exact_dedup(request.getfixturevalue(source)).collect()
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[t or ""].append(i)
    want = sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGE)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)


def test_op1_compares_full_bytes(spark, docs):
    """With a digest of one byte nearly all hits are false; the bytes part them again."""
    good = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_dedup(docs).collect()}
    weak = X.exact_dedup(docs, lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 2)))
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in weak.collect()} == good


def test_op1_state_carries_over(spark, tmp_path):
    store = X.DedupStore(spark, f"file://{tmp_path}/store")
    schema = "digest binary, doc_id bigint, file_key bigint, row_at bigint"
    for n, rows in enumerate([[(b"a", 1, 0, 0), (b"b", 2, 0, 1)], [(b"a", 9, 1, 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/keys")
        store.ingest(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/keys"))
        assert n or store.winners().count() == 2
    assert {(bytes(r["digest"]), r["keep"]["doc_id"], r["group_size"]) for r in store.winners().collect()} == {(b"a", 9, 2), (b"b", 2, 1)}


@pytest.mark.parametrize("digest", [X.sha256, lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 2))])
def test_op1_two_ingests_equal_one(spark, docs, edge, tmp_path, digest):
    """Documents taken into a store in two runs come out as those of one run; the weak digest lets bytes decide across the two."""
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    half = docs.select("doc_id", "text").where("doc_id % 3 = 0").unionByName(docs.select("doc_id", "text").where("doc_id < 40"))
    store = f"file://{tmp_path}/store"
    X.exact_dedup(half, digest, store=store)
    X.exact_dedup(edge, digest, store=store)
    got = X.exact_dedup(docs, digest, store=store).select(columns).toPandas()
    want = X.exact_dedup(half.unionByName(edge.select("doc_id", "text")).unionByName(docs.select("doc_id", "text")), digest).select(columns).toPandas()
    key = lambda frame: sorted(map(repr, frame[["doc_id", "keep_id", "group_size", "text_sha256"]].astype(object).where(frame.notna(), None).itertuples(index=False)))
    assert key(got) == key(want) and got["kept"].sum() == want["kept"].sum() and len(got) > len(docs.columns)


def test_op1_large_groups_meet_their_winner(spark, docs, monkeypatch):
    monkeypatch.setattr(X, "HOT_ROWS", 1)
    one = X.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").toPandas()
    monkeypatch.undo()
    other = X.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").toPandas()
    assert one.sort_values("doc_id").reset_index(drop=True).equals(other.sort_values("doc_id").reset_index(drop=True))


def test_op1_empty(nothing):
    assert X.exact_dedup(nothing).collect() == []
    assert X.kept_documents(nothing).columns == nothing.columns


def test_op1_kept_documents_keep_their_columns(edge):
    kept = X.kept_documents(edge)
    assert kept.columns == edge.columns and kept.count() == len({t or "" for _, t in EDGE})


def brute_components(fps, ids, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, doc in enumerate(ids):
        least[root(i)].append(doc)
    return [min((d for d in least[root(i)] if d is not None), default=None) for i in range(len(ids))]


def brute_fingerprint(text, words=3):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [50_000, 2])
def test_op6_against_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_IN_BLOCK", most)  # 2: nearly every block is dealt out again
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    got = sorted((r["doc_id"], bytes(r["fp"]).hex(), r["component_id"]) for r in S.near_components(docs).collect())
    assert got == sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components(fps, [i for i, _ in rows], 3), strict=True))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op6_takes_every_pair_from_the_index(sf, monkeypatch):
    """All links of the query's fingerprints come out of GrayIndex, which holds every one of them under each of its blocks, whatever a block's size; and they
    are those of a plain comparison of whatever shares a block."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    fps = sorted({S.fingerprint(S.shingle_hashes((t or "").encode(), 3)) for t in texts})
    codes = np.array([int.from_bytes(f, "big") for f in fps], np.uint64)
    blocks = S.exact_blocks(64, 3)
    keyed = sorted((bytes([0, 0, i]) + f[2 * i : 2 * i + 2], f) for f in fps for i in range(len(blocks)))
    held, pairs = [], []

    class Watched(G.GrayIndex):
        def lower_neighbours(self, radius, room=1 << 21):
            held.append(len(self.runs))
            for a, b, apart in super().lower_neighbours(radius, room):
                pairs.append((self.patterns[0][a].ravel(), self.patterns[0][b].ravel()))
                yield a, b, apart

    monkeypatch.setattr(S, "GrayIndex", Watched)
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([f for _, f in part], pa.binary())], names=["key", "fp"]) for part in (keyed[i : i + 10_000] for i in range(0, len(keyed), 10_000))]
    links = [(a, b) for out in S._link(3, 8)(iter(batches)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    found = {(int(max(a, b)), int(min(a, b))) for x, y in pairs for a, b in zip(x, y, strict=True)}
    want = set()
    for i in range(0, len(codes), 500):
        a, b = np.nonzero(np.bitwise_count(codes[i : i + 500, None] ^ codes[None]) <= 3)
        want |= {(int(codes[i + x]), int(codes[y])) for x, y in zip(a, b, strict=True) if codes[i + x] > codes[y]}
    assert sum(held) == len(keyed) and found == want
    linked = {tuple(sorted((int.from_bytes(a, "big"), int.from_bytes(b, "big")), reverse=True)) for a, b in links}
    label = {int(c): int(c) for c in codes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for edges in (linked, want):  # the links handed on join what all pairs join
        before = sum(root(int(c)) == int(c) for c in codes)
        for a, b in edges:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    assert sum(root(int(c)) == int(c) for c in codes) == before


def test_blocks_bring_pairs_together():
    """Blocks grow with the number of fingerprints, and their number with that; of pairs at 0.8 some 99 in 100 share one."""
    rng = np.random.default_rng(2)
    p = S.bit_differs(0.8)
    for n, length in ((10, 16), (1 << 20, 16), (1 << 23, 19)):
        at = np.array(S.blocks_for(n, 0.8, 256))
        assert at.shape[1] == length
        differ = rng.random((3000, 256)) < p
        assert (~differ[:, at].any(axis=2)).any(axis=1).mean() >= 0.98


def test_op6_edges(edge, nothing):
    got = sorted((str(r["doc_id"]), bytes(r["fp"]).hex(), str(r["component_id"])) for r in S.near_components(edge).collect())
    fps = [int.from_bytes(S.fingerprint(S.shingle_hashes((t or "").encode(), 3)), "big") for _, t in EDGE]
    assert got == sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(EDGE, fps, brute_components(fps, [i for i, _ in EDGE], 3), strict=True))
    assert S.near_components(nothing).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("500", f"{i}") for i in range(501, 560)] + [("700", "700")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {got[f"{i:03d}"] for i in range(1, 41)} == {"000"} and {got[f"{i}"] for i in range(501, 560)} == {"500"} and "700" not in got


@pytest.mark.parametrize("words", [1, 3])
def test_gray_index_loses_no_pair(words):
    rng = np.random.default_rng(words)
    codes = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64).repeat(12, axis=0)
    codes ^= np.uint64(1) << rng.integers(0, 63, codes.shape, dtype=np.uint64)
    codes = codes[G.gray_order(codes)]
    found = [np.concatenate(part) for part in zip(*G.GrayIndex(codes).lower_neighbours(4), strict=True)]
    got = {(int(a), int(b)) for a, b, _ in zip(*found, strict=True)}
    assert np.array_equal(found[2], G.distance(codes[found[0]], codes[found[1]]))
    assert got == {(a, b) for a in range(len(codes)) for b in range(a) if G.distance(codes[a], codes[b]) <= 4}
    small = np.arange(16, dtype=np.uint64).reshape(-1, 1)
    steps = small[G.gray_order(small)].ravel()
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(steps, steps[1:], strict=False))


def test_near_copies_at_a_similarity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows, sure = [], []
    for d in range(60):
        text = [words[i] for i in rng.integers(0, 5000, 400)]
        other = list(text)
        if d % 2 == 0:
            other[int(rng.integers(0, 400))] = "changed"  # 5 of 396 shingles differ
            sure.append((2 * d, 2 * d + 1))
        else:
            other = [words[i] for i in rng.integers(0, 5000, 400)]
        rows += [(2 * d, " ".join(text)), (2 * d + 1, " ".join(other))]
    got = S.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas().set_index("doc_id")["component_id"]
    assert all(got[a] == got[b] for a, b in sure)
    assert all(got[i] == i for i in got.index if i // 2 % 2 == 1)


def test_without_near_copies_keeps_columns(edge):
    kept = S.without_near_copies(edge)
    assert kept.columns == edge.columns
    assert isinstance(kept.toPandas(), pd.DataFrame)


def brute_similar(texts, words=5, at_least=0.8):
    """Groups of texts joined by shingle similarity, each as a set of places."""
    sets = [set(S.shingle_hashes((t or "").encode(), words).tolist()) for t in texts]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if texts[i] == texts[j] or (x and y and len(x & y) >= at_least * len(x | y)):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return label


@pytest.mark.parametrize("most", [50_000, 3])
def test_near_copies_against_brute_force(spark, monkeypatch, most):
    """Families of texts around the similarity: no group holds what brute force keeps apart, and few true pairs are missed."""
    monkeypatch.setattr(S, "MOST_IN_BLOCK", most)  # 3: nearly every key is dealt out again in chunks
    monkeypatch.setattr(S, "MOST_IN_GROUP", most)
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(25):
        words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        for changes in (0, 1, 3, 5, 6, 8, 12):
            other = list(words)
            for at in rng.integers(0, 300, changes):
                other[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(other))
    texts += ["", None, "one two", "one  two"]
    label = brute_similar([t or "" for t in texts])
    got = S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).toPandas().set_index("doc_id")["component_id"]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if label[i] == label[j]]
    joined = {(i, j) for i in range(len(texts)) for j in range(i) if got[i] == got[j]}
    assert joined <= set(pairs)
    assert len(joined) >= 0.97 * len(pairs)


def test_alike_is_the_exact_similarity():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 62, 300)
    sets = [np.unique(np.concatenate([rng.choice(base, int(n), replace=False), rng.integers(0, 1 << 62, int(m))])) for n, m in zip(rng.integers(0, 300, 60), rng.integers(0, 40, 60), strict=True)]
    sets += [np.empty(0, np.int64), np.empty(0, np.int64), sets[3]]
    got = set(zip(*(x.tolist() for x in S.alike(sets, 0.6)), strict=True))
    plain = [set(x.tolist()) for x in sets]
    assert got == {(i, j) for i, x in enumerate(plain) for j, y in enumerate(plain[:i]) if x and len(x & y) >= 0.6 * len(x | y)} and len(got) > 20


def test_a_large_family_is_cut_without_loss(spark, monkeypatch):
    """A chain of texts, each like the next, of falling lengths: cut by lengths and into chunks, every link is still found."""
    monkeypatch.setattr(S, "MOST_IN_GROUP", 7)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[: 400 - 9 * i]) for i in range(30)]
    got = S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).toPandas().set_index("doc_id")["component_id"]
    label = brute_similar(texts)
    assert [got[i] for i in range(30)] == label and len(set(label)) < 30


def test_near_copies_recall_on_the_tables(spark):
    """Every pair of texts of sf0.01 at a similarity of 0.8 or more (in five-word shingles) is joined, and nothing that chains of such pairs don't join."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").toPandas()
    sets = [np.unique(S.shingle_hashes((t or "").encode(), 5)) for t in rows["text"]]
    holders = defaultdict(list)
    for i, x in enumerate(sets):
        for h in x.tolist():
            holders[h].append(i)
    shared = defaultdict(int)
    for places in holders.values():
        for x in range(len(places)):
            for y in range(x):
                shared[places[x], places[y]] += 1
    pairs = {(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    got = S.near_copies(docs).toPandas().set_index("doc_id")["component_id"]
    of = got.loc[rows["doc_id"]].to_numpy()
    found = sum(of[i] == of[j] for i, j in pairs)
    assert found >= 0.97 * len(pairs) and len(pairs) > 10
    for group in pd.Series(range(len(of))).groupby(of):
        assert len({root(i) for i in group[1]} - {root(i) for i in group[1] if not len(sets[i])}) <= 1


def test_short_near_copies_lose_none(spark):
    """Of 8 words against 9 (4 shingles of 5), and 12 shingles of 15: fingerprints alone bring some 59 and 88 in 100 together."""
    rng = np.random.default_rng(5)
    texts = []
    for shingles, more in ((4, 1), (12, 3), (5, 1)):
        for _ in range(60):
            words = [f"w{i}" for i in rng.integers(0, 50_000, shingles + 4 + more)]
            texts += [" ".join(words[: shingles + 4]), " ".join(words)]
    got = S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).toPandas().set_index("doc_id")["component_id"]
    assert [i for i in range(len(texts)) if got[i] != i - i % 2] == []
