"""Document fingerprints by winnowing (operator 4). DataFrame and SQL functions only.

A text is read as units, cut where its own characters say so: after certain letters and digits (every tenth character or so), and
around every character of scripts that are written without spaces. A copy that stands elsewhere thus has the same units from its
first cut on. Every unit is hashed once; the hash of a run of GRAM units is the cyclic-polynomial rolling hash of their hashes (64 bits). Of every window of WINDOW grams the one with the least
hash (its first 33 bits decide) is kept, the rightmost of equal ones, with the place of its first character. Windows hang over both
ends of the text. Two texts that share GRAM + WINDOW - 1 consecutive units thus share a print, whatever stands around them, and equal
texts have equal fingerprints.

Defined results: a null text counts as empty; a text of fewer units than a gram is hashed whole; a run of more than LONGEST characters
without a cut is cut every LONGEST from the last cut on; of rows with equal doc_id the next is by place in the table; the only document of a table is its own next; whole texts are read, however long; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of, with_locator

GRAM, WINDOW = 2, 3
LOW = (1 << 31) - 1
CUT = "mMuUwWlLgG05"  # a unit ends after these
ALONE = r"\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{ABFF}\x{F900}-\x{10FFFF}"  # scripts without spaces between words, and symbols
LONGEST = 64
UNIT = rf"(?s)[^{CUT}{ALONE}]{{0,{LONGEST - 1}}}[{CUT}]|[^{CUT}{ALONE}]{{1,{LONGEST}}}|[{ALONE}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def rolling(units: Column, gram: int) -> Column:
    """Of each run of gram hashes the cyclic polynomial: from hash to hash what there is turns by a bit, and the next is joined by exclusive or."""
    out = units
    for k in range(1, gram):
        out = F.zip_with(F.slice(out, 1, F.greatest(F.size(units) - k, F.lit(0))), F.slice(units, k + 1, F.size(units)), lambda h, u: rotated(h, 1).bitwiseXOR(u))
    return out


def doubled(values: Column, join: Callable[[Column, Column], Column], span: int) -> Column:
    """Of each value and the span - 1 after it what join makes of them, by doubling; at the end null stands for what isn't there. Steps beyond the last value are left out."""
    steps, done = [], 1
    while done < span:
        steps.append(min(done, span - done))
        done += steps[-1]
    taken = F.filter(F.array(*map(F.lit, steps)), lambda step: step < F.size(values))
    return F.aggregate(taken, values, lambda v, step: F.zip_with(v, F.slice(v, step + 1, F.size(v)), join))


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept prints (hash, at) in text order."""
    low = F.lit(LOW).cast("bigint")
    ahead = F.array_repeat(F.lit((1 << 63) - 1).cast("bigint"), window - 1)
    # A key is the start of the hash, then what is left to the number of the gram, so that the least is the rightmost of equal ones.
    key = lambda h, i: F.shiftleft(F.shiftright(h, 31), 31).bitwiseOR(low - i)
    number = lambda k: (low - k.bitwiseAND(low)).cast("int")

    def of_grams(pieces: Column, grams: Column) -> Column:
        keys = let(F.concat(ahead, F.transform(grams, key)), lambda keys: doubled(keys, lambda a, b: F.least(a, b), window))
        # How many characters there are from each piece to the end: pieces hold all from the first one on.
        from_here = let(F.transform(pieces, lambda p: F.char_length(p)), lambda n: doubled(n, lambda a, b: a + F.coalesce(b, F.lit(0)), 1 << 31))
        place = lambda rest, n: lambda k: F.struct(F.get(grams, number(k)).alias("hash"), (n - F.get(rest, number(k))).alias("at"))
        return let(from_here, lambda rest: let(F.char_length(text), lambda n: F.transform(F.array_distinct(keys), place(rest, n))))

    def of_pieces(pieces: Column) -> Column:
        whole = F.array(F.struct(F.xxhash64(text).alias("hash"), F.lit(0).alias("at")))
        grams = let(F.transform(pieces, lambda p: F.xxhash64(p)), lambda h: rolling(h, gram))
        return F.when(F.size(pieces) < gram, whole).otherwise(let(grams, lambda g: of_grams(pieces, g)))

    return let(F.regexp_extract_all(text, F.lit(UNIT), 0), of_pieces)


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def as_string(prints: Column) -> Column:
    """hash@place, hexadecimal, joined by commas."""
    return F.lower(F.array_join(F.transform(prints, lambda p: F.concat(F.hex(p["hash"]), F.lit("@"), F.hex(p["at"]))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of both (arrays without repeats)."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


ORDER = ["doc_id", "file_key", "row_at"]


def ranges(rows: DataFrame) -> list:
    """First keys (doc_id, file_key, row_at) of ranges that hold about as many rows each, rising; only those, one for each partition, reach the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(*ORDER).repartitionByRange(n, *ORDER).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*ORDER)).alias("first"))
    return [tuple(r["first"]) for r in ranged.orderBy("first").collect()]


def range_of(firsts: list) -> tuple[Column, Column]:
    """The number of the range that the row's key is in, and whether it is the first of its range. Searched in two steps of some square root of
    the number of ranges each."""
    kind = "array<struct<doc_id:bigint,file_key:bigint,row_at:bigint>>"
    step = max(1, round(len(firsts) ** 0.5))
    array = lambda keys: F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(ORDER, k, strict=True)]) for k in keys]).cast(kind)
    below = lambda keys: F.size(F.filter(keys, lambda k: k <= F.struct(*ORDER)))
    every = array(firsts)
    part = let(F.greatest(below(array(firsts[::step])) - 1, F.lit(0)) * step, lambda at: at + F.greatest(below(F.slice(every, at + 1, step)) - 1, F.lit(0)))
    return part, F.array_contains(every, F.struct(*ORDER))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, prints of each text, the edited text (its last quarter replaced by the start of the next document's) and its prints, and the next document's hashes.

    Texts are dealt out once, by ranges of doc_id; the first row of each range goes to the range before it too (that of the first to the last), so that every row has its next beside it."""
    spark = docs.sparkSession
    located = with_locator(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), "file_key", "row_at")
    firsts = ranges(located)
    if not firsts:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, prints array<struct<hash:bigint,at:int>>, edited string, next_hashes array<bigint>, edited_prints array<struct<hash:bigint,at:int>>")
    part, is_first = range_of(firsts)
    before = F.pmod(F.col("part") - 1, F.lit(len(firsts)))
    own, guest = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(before.alias("part"), F.lit(True).alias("guest"))
    placed = located.withColumns({"part": part, "is_first": is_first}).select(*ORDER, "text", F.explode(F.when(F.col("is_first"), F.array(own, guest)).otherwise(F.array(own))).alias("to")).select(*ORDER, "text", "to.*")
    read = placed.repartitionByRange(len(firsts), "part").withColumns({"prints": winnowed(F.col("text")), "n_chars": F.char_length("text").cast("bigint")}).withColumn("hashes", hashes(F.col("prints")))
    beside = Window.partitionBy("part").orderBy("guest", *ORDER)
    both = read.withColumns({"next_text": F.lead("text").over(beside), "next_hashes": F.lead("hashes").over(beside)}).where("not guest")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter))
    return both.select("doc_id", "n_chars", "prints", edited.alias("edited"), "next_hashes").withColumn("edited_prints", winnowed(F.col("edited")))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    near = let(hashes(F.col("prints")), lambda h: F.struct(likeness(h, hashes(F.col("edited_prints"))).alias("edited"), likeness(h, F.col("next_hashes")).alias("next")))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("prints")).alias("fingerprint"), as_string(F.col("edited_prints")).alias("edited_fingerprint"), near.alias("near")
    ).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))
