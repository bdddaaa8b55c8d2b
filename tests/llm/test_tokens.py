import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing, sentencepiece_codec, token_store
from corpusloom.llm.tokenize import byte_bpe, word_bpe

from .conftest import EDGE

BYTE, WORD, PIECE = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXT = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("日😀̈ſ▁  "), st.sampled_from("'stredm _.!1 \n")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoders_like_the_libraries(text):
    b, w, s = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), _piece()
    assert byte_bpe(BYTE)(text) == b.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_bpe(WORD)(text), "<u4").tolist() == w.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(sentencepiece_codec.codec(PIECE)[0](text), "<u4").tolist() == s.encode(text, add_bos=True, add_eos=True)


def _piece(cache=[]):  # noqa: B006
    if not cache:
        cache.append(sentencepiece.SentencePieceProcessor(model_file=PIECE))
    return cache[0]


def test_every_near_code_point():
    w, fast = Tokenizer.from_file(WORD), word_bpe(WORD)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f".{c}.", c * 2, f"_{c}", f"{c}'s"):
            assert np.frombuffer(fast(text), "<u4").tolist() == w.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|STARTOFTEXT|> b", "<|endoftext|"])
def test_special_strings(text):
    assert byte_bpe(BYTE)(text) == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_bpe(WORD)(text), "<u4").tolist() == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("source", ["docs", "edge"])
def test_op2_pieces_and_bins(request, source):
    frame = request.getfixturevalue(source)
    library, want = Tokenizer.from_file(BYTE), []
    for r in frame.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(str(r["doc_id"]), i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.pack(frame, BYTE).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 1024 + 2


def test_op2_empty(nothing):
    assert packing.pack(nothing, BYTE).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 6), st.integers(10_000, 12_000), st.sampled_from(["norm", "dot"]))
def test_op2_every_capacity_holds(lengths, documents, attention, score):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit(lengths, 100, documents, attention, score)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= documents and (mine**2).sum() <= attention
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(mine[order]) - mine[order] == offsets[bins == b][order]).all()


def plain_fit(lengths, caps, score, weights):
    """Piece after piece, longest first: into the feasible bin that scores best, the oldest of equal ones, else into a new one. With the dot product a bin that was
    chosen for a length keeps taking pieces of that length."""
    bins, last = [], None
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [i for i, left in enumerate(bins) if (left >= need).all()]
        room = lambda i: bins[i] / caps  # noqa: E731, B023
        if score == "dot" and last is not None and last[0] == n and last[1] in fits:
            pick = last[1]
        elif fits:
            by = {i: (weights * (room(i) - need / caps) ** 2).sum() if score == "norm" else -(weights * (need / caps) * room(i)).sum() for i in fits}
            pick = min(fits, key=lambda i: (round(by[i], 12), i))  # noqa: B023
        else:
            bins.append(np.array(caps, np.int64))
            pick = len(bins) - 1
        bins[pick] = bins[pick] - need
        last = (n, pick)
    return sorted(tuple(b.tolist()) for b in bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_op2_bins_are_those_of_a_plain_search(score):
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = rng.integers(1, 101, int(rng.integers(1, 120)))
        caps = np.array([100, int(rng.integers(2, 8)), int(rng.integers(10_000, 12_000))])
        bins, _ = packing.best_fit(lengths, *caps.tolist(), score)
        got = sorted((caps - np.array([lengths[bins == b].sum(), (bins == b).sum(), (lengths[bins == b] ** 2).sum()])).tolist() for b in np.unique(bins))
        assert [tuple(g) for g in got] == plain_fit(lengths.tolist(), caps, score, np.array([1.0, 0.05, 0.05]))


def test_op2_two_runs_give_the_same_sequences(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 60)
    groups = []
    for _ in range(2):
        rows = packing.pack(docs, BYTE).toPandas()
        groups.append(sorted(tuple(sorted(zip(g["doc_id"], g["piece"], g["offset"], strict=True))) for _, g in rows.groupby("sequence_id")))
    assert groups[0] == groups[1] and len(groups[0]) > 10


@pytest.mark.parametrize("source", ["docs", "edge"])
def test_op7_round_trip(request, source):
    frame, library = request.getfixturevalue(source), _piece()
    want = []
    for r in frame.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((str(r["doc_id"]), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids)))
    got = [(str(r["doc_id"]), hashlib.sha256(bytes(r["ids"])).hexdigest(), r["decoded"]) for r in sentencepiece_codec.coded(frame, PIECE).collect()]
    assert sorted(got) == sorted(want)


def test_op7_empty(nothing):
    assert sentencepiece_codec.coded(nothing, PIECE).collect() == []


@pytest.mark.parametrize("source", ["docs", "edge"])
def test_op10_files_in_order(spark, request, source, tmp_path):
    frame, library = request.getfixturevalue(source), Tokenizer.from_file(WORD)
    folder = f"file://{tmp_path}/tokens"
    token_store.TokenStore.write(frame, folder, WORD)
    store = token_store.TokenStore.open(spark, folder)
    shards = sorted((tmp_path / "tokens/shards").glob("*.ids"))
    ids = np.concatenate([np.fromfile(p, f"<u{store.manifest['width']}") for p in shards]).astype("<u4")
    rows = frame.select("doc_id", "text").toPandas()
    want = defaultdict(list)
    for i, t in zip(rows["doc_id"], rows["text"], strict=True):
        key = None if i != i else int(i)
        want[key].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    keys = spark.createDataFrame([(k, c) for k, v in want.items() for c in range(len(v))] + [(10**9, 0), (12, 1)], "doc_id bigint, copy bigint")
    got = store.read(keys).collect()
    assert len(got) == len(rows)
    found = defaultdict(list)
    for r in got:
        mine = bytes(r["ids"])
        assert ids[r["start"] : r["start"] + len(mine) // 4].tobytes() == mine
        found[r["doc_id"]].append(mine)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    ordered = sorted(got, key=lambda r: r["start"])
    keys = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys) and ordered[0]["start"] == 0


def test_op10_one_key_over_many_shards(spark, tmp_path):
    """Most rows have one doc_id, or none: they fill several shards, copies are numbered through, and each is found again."""
    rows = [(7 if i % 10 else None, f"text {i}") for i in range(300)] + [(9, "end"), (-(1 << 63), "least")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        store = token_store.TokenStore.write(spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}/hot", WORD)
        got = store.read(store.places.select("doc_id", "copy")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(store.manifest["names"]) > 3 and len(got) == len(rows)
    library = Tokenizer.from_file(WORD)
    want = sorted((str(k), np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    assert sorted(r["copy"] for r in got if r["doc_id"] == 7) == list(range(270))


def test_op10_leftovers_of_other_attempts_are_not_read(spark, docs, tmp_path):
    store = token_store.TokenStore.write(docs, f"file://{tmp_path}/t", WORD)
    for p in list((tmp_path / "t/shards").glob("*.ids")):
        (p.parent / f"{p.name.split('-')[0]}-dead.ids").write_bytes(b"\0" * 100)
    got = token_store.TokenStore.open(spark, store.folder).read(store.places.select("doc_id", "copy"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_op10_schemes():
    assert token_store.arrow_uri("s3a://bucket/a b") == "s3://bucket/a b" and token_store.arrow_uri("hdfs://n:8020/x") == "hdfs://n:8020/x" and token_store.arrow_uri("/x") == "/x"


def test_op10_index_finds_what_the_hash_finds(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    n = np.arange(len(keys))
    token_store.put(f"file://{tmp_path}/i.mph", token_store.dump_index(keys, n % 7, n * 3, n))
    index = token_store.Index(f"file://{tmp_path}/i.mph")
    found, there = index.find(keys)
    assert there.all() and (found["first"] == n * 3).all() and np.array_equal(np.sort(index.places(keys)), n)
    assert index.find(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) | np.uint64(1 << 63))[1].sum() <= 1


def test_op10_empty(spark, nothing, tmp_path):
    store = token_store.TokenStore.write(nothing, f"file://{tmp_path}/none", WORD)
    assert store.manifest["documents"] == 0 and store.read(store.places.select("doc_id", "copy")).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), unique=True, max_size=300))
def test_op10_perfect_hash_is_minimal(keys):
    mixed = token_store.key_of(np.array(keys, np.int64), np.zeros(len(keys), np.int64))
    slots = token_store.PerfectHash.build(mixed).slots(mixed)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_edge_rows_are_all_there(edge):
    assert edge.count() == len(EDGE)
