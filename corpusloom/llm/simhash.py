"""SimHash near-duplicates through a Gray-order hierarchical index (operator 6).

Fingerprints are taken of word shingles. Distinct fingerprints are dealt out by masked blocks of bits: with more blocks than
differing bits allowed, every linked pair shares a block exactly, so none is lost. A task builds one index, by block and then in Gray
order, over all fingerprints that it was dealt; every pair comes from a search of that index within the radius, whatever the size of
a block. It hands on a spanning forest of what it has linked, never all pairs. Blocks with very many fingerprints are dealt out once
more in chunks, every two of which meet, which keeps the result whole.

At a similarity of shingles instead of a distance, chains of such links only say which texts may be alike: families. Within a family the exact
similarity of every two texts is computed where their shingles have been brought together, and a spanning forest of what is alike is handed on; a large
family is cut by lengths (texts that are alike are nearly as long) and then into chunks, every two of which meet.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; repeated rows
come out as often as they occur; a null doc_id is ignored by the smallest doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, scanned, small_or_not, text_of, with_locator, without_rows, written
from .components import components
from .gray_index import Forest, GrayIndex, gray_rank

#: A key with more fingerprints than this is dealt out again, in chunks.
MOST_IN_BLOCK = 50_000
BLOCK, SHINGLE = b"\0", b"\1"  # first bytes of the two kinds of keys
MOST_IN_GROUP = 1024  # texts of a family that one task compares at once
MOST_HELD = 4_000_000  # and shingles of them
SHORT = 62  # texts of up to so many distinct shingles are brought together by shingles too: any as short as 49, with all that can be 0.8 like it

Blocks = Sequence[tuple[int, ...]]  # bit positions of each block, as many in each


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, repeats included; A-Z lower-cased, words parted by ASCII white space."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return np.fromiter((digest(join(s), 42) for s in zip(*(found[i:] for i in range(words)), strict=False)), np.uint64, len(found) - words + 1)


def fingerprint(hashes: np.ndarray, words64: int = 1) -> bytes:
    """Bits set in over half the hashes, most significant first. Further 64-bit words come from further mixes of each hash."""
    out = []
    for k in range(words64):
        h = hashes
        if k:
            h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        of_byte = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        counts = np.zeros(64, np.int64)
        for i in range(0, len(of_byte), 4096):
            counts += np.unpackbits(of_byte[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(rows: DataFrame, words: int, bits: int, keep: Sequence[str], repeats: bool = True) -> DataFrame:
    """The columns keep, and fp (binary) of the column text's shingles, repeats included or not; if not, also n, how many they are."""
    fields = [f for f in rows.schema.fields if f.name in keep]
    names = [f.name for f in fields]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            hashes = (shingle_hashes(t, words) for t in texts)
            found = [(fingerprint(h, bits // 64), len(h)) for h in (h if repeats else np.unique(h) for h in hashes)]
            columns = [pa.array([fp for fp, _ in found], pa.binary()), *([] if repeats else [pa.array([n for _, n in found], pa.int32())])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*names, *["fp", "n"][: len(columns)]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", fp binary" + ("" if repeats else ", n int")
    return rows.select(*names, text_of().cast("binary").alias("text")).mapInArrow(of, schema)


def _pairs(codes: np.ndarray, runs: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of rows of one run at most their radius apart, and their distances: one index in Gray order over all runs."""
    order = np.lexsort((*gray_rank(codes).T[::-1], runs))
    for a, b, apart in GrayIndex(codes[order], runs).lower_neighbours(radius):
        yield order[a], order[b], apart


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition that is sorted by its first column, cut so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        start = 0
        if batch.num_rows > 1:
            turns = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
            start = int(turns[-1]) + 1 if len(turns) else 0
        if start or (held and held[-1].column(0)[-1] != keys[0]):
            rows = [*held, batch.slice(0, start)] if start else held
            yield pa.Table.from_batches(rows).combine_chunks().to_batches(max_chunksize=None)[0]
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]


def _runs(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and how long it is."""
    new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return starts, np.diff(np.append(starts, len(keys)))


def _links(names: np.ndarray, forest: Forest) -> pa.RecordBatch | None:
    """The links a, b of a forest over rows with names."""
    moved = np.flatnonzero(forest.parent != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([of_bytes(names[moved]), of_bytes(names[forest.parent[moved]])], names=["a", "b"]) if len(moved) else None


def _link(radius: int, width: int):
    """For partitions of key, fp sorted by key: a spanning forest a, b of the fingerprints at most radius bits apart of each key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches):
            starts, sizes = _runs(batch.column(0))
            raw = bytes_of(batch.column(1), width)
            forest = Forest(len(raw))
            for a, b, _ in _pairs(np.ascontiguousarray(raw).view(">u8").astype(np.uint64), np.repeat(np.arange(len(starts)), sizes), radius):
                forest.join(a, b)
            if (found := _links(raw, forest)) is not None:
                yield found

    return task


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets (sorted, without repeats) that have the similarity (shared over all elements), each once. An empty set is like none.

    Shared elements are counted by products of blocks of the incidence matrix of what at least two sets hold."""
    sizes = np.array([len(s) for s in sets])
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, column, holders = np.unique(values, return_inverse=True, return_counts=True)
    several = holders[column] > 1
    owner, column = owner[several], (np.cumsum(holders > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, (low, low + width)))
        held = np.zeros((len(sets), width), np.float32)
        held[owner[part], column[part] - low] = 1
        shared += held @ held.T
    good = (shared > 0) & (shared >= similarity * (sizes[:, None] + sizes[None, :] - shared.astype(np.float64)))
    return np.nonzero(np.tril(good, -1))


def _confirm(similarity: float, width: int):
    """For partitions of key, fp, shingles sorted by key: a spanning forest a, b of the texts of each key that have the similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches):
            starts, sizes = _runs(batch.column(0))
            raw, shingles = bytes_of(batch.column(1), width), batch.column(2)
            ends, values = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False)
            forest = Forest(len(raw))
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                a, b = alike([values[ends[i] : ends[i + 1]] for i in range(start, start + size)], similarity)
                forest.join(start + a, start + b)
            if (found := _links(raw, forest)) is not None:
                yield found

    return task


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width)


def of_bytes(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def by_blocks(distinct: DataFrame, bits: int, blocks: Blocks) -> DataFrame:
    """key, fp: each fingerprint (column fp, each once) under the key of each of its blocks."""
    at = np.array(blocks)
    numbers = np.arange(len(at))
    head = np.stack([np.full(len(at), BLOCK[0]), numbers >> 8, numbers & 255], axis=1).astype(np.uint8)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                raw = bytes_of(batch.column(0).slice(i, 2048), bits // 8)
                of_blocks = np.packbits(np.unpackbits(raw, axis=1)[:, at], axis=2)
                keys = np.concatenate([np.broadcast_to(head, (len(raw), *head.shape)), of_blocks], axis=2)
                yield pa.RecordBatch.from_arrays([of_bytes(keys.reshape(-1, keys.shape[2])), of_bytes(raw.repeat(len(at), axis=0))], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(of, "key binary, fp binary")


def dealt_again(keyed: DataFrame, most: int) -> DataFrame:
    """keyed (key, fp, further columns), with each key of over most rows cut into chunks by a hash: every two chunks, and each with itself, have a key
    of their own, so that any two rows of the key still meet, in tasks of bounded size. With a column n, what a row holds, a key may hold MOST_HELD too."""
    held = F.ceil(2 * F.sum("n") / MOST_HELD) if "n" in keyed.columns else F.lit(1)
    sized = keyed.groupBy("key").agg(F.greatest(F.ceil(2 * F.count(F.lit(1)) / most), held).cast("int").alias("chunks"))
    large = written(sized.where("chunks > 2").select(F.col("key").alias("large"), "chunks"), "large")
    n = large.count()
    if not n:
        return keyed
    side = small_or_not(large, n, 40)
    rows = keyed.join(side, keyed.key == large.large, "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    kept = [c for c in keyed.columns if c != "key"]
    other = rows.select("key", *kept, "chunk", F.explode(F.when(F.col("large").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("other"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    return other.select(F.when(F.col("chunk").isNull(), F.col("key")).otherwise(F.concat("key", number(F.least("chunk", "other")), number(F.greatest("chunk", "other")))).alias("key"), *kept)


def dealt_by_length(keyed: DataFrame, similarity: float, most: int) -> DataFrame:
    """keyed (key, fp, n), with each key of over most rows cut by n: sets that are alike are in one class of lengths or in two that follow each other,
    and every class has a key of its own and meets the next one in another."""
    large = written(keyed.groupBy("key").count().where(F.col("count") > most).select(F.col("key").alias("large")), "large")
    n = large.count()
    if not n:
        return keyed
    # Half a class more than the similarity asks for keeps lengths at the border of the ratio in classes that follow each other.
    class_ = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / -math.log(similarity - 1e-6)).cast("int")
    rows = keyed.join(small_or_not(large, n, 40), keyed.key == large.large, "left")
    cut = rows.select("key", "fp", "n", F.explode(F.when(F.col("large").isNull(), F.array(F.lit(-1))).otherwise(F.array(class_, class_ + 1))).alias("class"))
    return cut.select(F.when(F.col("class") < 0, F.col("key")).otherwise(F.concat("key", F.unhex(F.lpad(F.hex("class"), 8, "0")))).alias("key"), "fp", "n")


def by_key(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "fp")


def linked(keyed: DataFrame, bits: int, radius: int) -> DataFrame:
    """Links a, b between fingerprints at most radius bits apart that share a key: a spanning forest of each."""
    return by_key(keyed.select("key", "fp")).mapInArrow(_link(radius, bits // 8), "a binary, b binary")


def exact_blocks(bits: int, radius: int) -> Blocks:
    """One more block than bits may differ: any two codes within the radius agree in one block at least."""
    each = bits // (radius + 1)
    return [tuple(range(i * each, (i + 1) * each)) for i in range(radius + 1)]


def blocks_for(fingerprints: int, similarity: float, bits: int, missed: float = 0.01) -> Blocks:
    """Blocks cut out of permutations of the bits. Their length grows with the number of fingerprints, so that a block's key has some sixteen of them
    at most, and there are so many that a pair at the similarity has none in common with a chance of missed."""
    length = min(bits, max(16, math.ceil(math.log2(max(fingerprints, 2))) - 4))
    p = bit_differs(similarity)
    apart = [(math.comb(bits, d) * p**d * (1 - p) ** (bits - d), 1 - math.comb(bits - d, length) / math.comb(bits, length)) for d in range(bits + 1)]
    cuts = bits // length
    rounds = next(r for r in range(1, 1 << 20) if sum(chance * none ** (r * cuts) for chance, none in apart) <= missed)
    rng = np.random.default_rng(length)
    return [tuple(part) for _ in range(rounds) for part in rng.permutation(bits)[: cuts * length].reshape(cuts, length).tolist()]


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """fp, and the distinct shingle hashes of the column text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])

    return rows.select("fp", text_of().cast("binary").alias("text")).mapInArrow(of, "fp binary, shingles array<bigint>")


def sets_of(asked: DataFrame, located: DataFrame, words: int) -> DataFrame:
    """fp and shingles of the asked texts (fp, file_key, row_at)."""
    texts = located.select("file_key", "row_at", "text").join(small_or_not(asked, asked.count(), 200), ["file_key", "row_at"])
    return written(shingle_sets(texts, words), "shingles")


def by_shingles(short: DataFrame, similarity: float) -> DataFrame:
    """key, fp: each short text (fp, shingles) under the keys of its rarest shingles, so many that texts of the similarity have one in common."""
    each = short.select("fp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = written(each.groupBy("shingle").count().where("count > 1"), "shared")
    ranked = each.join(small_or_not(shared, shared.count(), 16), "shingle").groupBy("fp").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("of"))
    # Of n shingles the first n - ceil(similarity x n) + 1; those that no other text has come before all others and bring nothing together.
    first = (F.size("of") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int")
    keys = ranked.withColumn("first", first).where("first > 0").select("fp", F.explode(F.slice("of", 1, F.col("first"))).alias("at"))
    return written(keys.select(F.concat(F.lit(SHINGLE), F.unhex(F.lpad(F.hex("at.shingle"), 16, "0"))).alias("key"), "fp"), "by_shingles")


def confirmed(distinct: DataFrame, links: DataFrame, located: DataFrame, bits: int, words: int, similarity: float) -> DataFrame:
    """node, root as components gives them, over all pairs of texts that have the similarity and are in one family of links or, if short, share a rare shingle."""
    where = distinct.select("fp", "n", "least.file_key", "least.row_at")
    family = components(links)
    members = family.select(F.col("root").alias("key"), F.col("node").alias("fp")).unionByName(family.select(F.col("root").alias("key"), F.col("root").alias("fp")).distinct())
    members = written(members.select(F.concat(F.lit(BLOCK), "key").alias("key"), "fp").join(where, "fp"), "families")
    short = sets_of(written(where.where(F.col("n").between(1, SHORT)).drop("n"), "asked"), located, words)
    long = sets_of(written(members.where(F.col("n") > SHORT).drop("key", "n"), "asked"), located, words)
    keyed = members.select("key", "fp", "n").unionByName(by_shingles(short, similarity).join(where.select("fp", "n"), "fp").select("key", "fp", "n"))
    dealt = dealt_again(dealt_by_length(keyed, similarity, MOST_IN_GROUP), MOST_IN_GROUP)
    rows = dealt.select("key", "fp").join(short.unionByName(long), "fp").select("key", "fp", "shingles")
    roots = components(by_key(rows).mapInArrow(_confirm(similarity, bits // 8), "a binary, b binary"))
    drop(members, short, long)
    return roots


def near_components(rows: DataFrame, words: int = 3, bits: int = 64, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, file_key, row_at, fp, component_id (smallest doc_id reachable), first (whether the row stands for its component).

    With a similarity, fingerprints are of distinct shingles, and texts within the radius are linked only if they have it."""
    located = with_locator(rows, ["doc_id", "text"])
    each = written(fingerprints(located, words, bits, ["doc_id", "file_key", "row_at"], similarity is None), "fingerprints")
    distinct = written(each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file_key", "row_at")).alias("least"), *([] if similarity is None else [F.max("n").alias("n")])), "distinct")
    blocks = exact_blocks(bits, radius) if similarity is None else blocks_for(distinct.count(), similarity, bits)
    links = linked(dealt_again(by_blocks(distinct, bits, blocks), MOST_IN_BLOCK), bits, radius)
    roots = components(links) if similarity is None else confirmed(distinct, links, located, bits, words, similarity)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written first: the join below then has an exchange on either side, and a root with very many fingerprints can be split.
    least = written(rooted.groupBy("root").agg(F.min("least").alias("first")), "roots")
    named = rooted.join(least, "root").select(F.col("fp").alias("fp_"), "first")
    out = each.join(named, each.fp == F.col("fp_"))
    stands = (F.col("first.file_key") == F.col("file_key")) & (F.col("first.row_at") == F.col("row_at"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "file_key", "row_at", "fp", F.col("first.doc_id").cast("bigint").alias("component_id"), stands.alias("first"))


def bit_differs(jaccard: float) -> float:
    """Chance that a bit differs between two texts of this shingle similarity: their cosine is 2j / (1 + j) at least, and the chance is angle / pi."""
    return math.acos(2 * jaccard / (1 + jaccard)) / math.pi


def radius_for(jaccard: float, bits: int, deviations: float) -> int:
    """Differing bits of pairs of exactly this shingle similarity, and so many deviations more."""
    p = bit_differs(jaccard)
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """near_components at a similarity of five-word shingles. Such texts differ in more bits than can be blocked exactly: blocks_for brings 99 in
    100 pairs of long texts of a similarity of 0.8 together, and nearly all from 0.85 on. In short texts bits are ties too often
    for that: those of up to SHORT shingles are brought together by shared shingles as well, which loses none.
    Distances up to 2.6 deviations above that of the similarity make families (996 in 1000 pairs at 0.8); within them the texts' shingles decide."""
    return near_components(docs, words, bits, radius_for(similarity, bits, 2.6), similarity)


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies, with its columns as they were."""
    docs = scanned(docs)
    return without_rows(docs, near_copies(docs, words, similarity).where("not first"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
