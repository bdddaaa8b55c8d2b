"""License scans by phrases and by an exact set-similarity join (operator 5). DataFrame and SQL functions only.

Base labels are places where a phrase's words stand consecutively. The join finds every text block (64 words, from every
32nd word on, so that any 32 consecutive words stand in one) that holds at least THRESHOLD of a template's distinct words. All words
of templates are ordered by how many documents hold them, rarest first, and template and block are both read in that order (a block's
other words can't be shared and are left out). A block must hold one of the template's first n - ceil(THRESHOLD n) + 1 words (prefix
filter) and enough words at all (length filter); from the first word that both hold, enough must be left on either side (positional
filter); what remains is counted exactly. A label is given only where the words that name its licence are in the block.

Defined results: a null text counts as empty (no words, no places, score 0); repeated rows come out as often as they occur; words
that equally many documents hold go by their letters; whole texts are read, however long; an empty table gives no rows; only doc_id
and text are read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_not, text_of, with_locator, written
from .winnow import let

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Labels, sentences of public licences (at most 32 words each), and the words among them that name the licence.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu public 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu public"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public 2"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
BLOCK, STEP = 64, 32


def needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased. Splitting takes a twentieth of the time that extracting matches of the complement takes."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN_WORDS), "")


def places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split()
    hit = lambda w, i: F.when(w == parts[0], F.coalesce(_all([F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)]), F.lit(False))).otherwise(False)
    return F.filter(F.transform(words, lambda w, i: F.when(hit(w, i), i)), lambda i: i.isNotNull())


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


Template = tuple[str, str, str]


def in_order(words: str, order: list[str]) -> list[int]:
    """Places of the distinct words in the order, from 1, rising."""
    return sorted(order.index(w) + 1 for w in set(words.split()))


def template_index(order: list[str], templates: list[Template], threshold: float) -> list[tuple[int, int, int, int, int]]:
    """(word's place in the order, template number, place in the template, distinct words, words needed) of every template's prefix words."""
    out = []
    for t, (_, text, _) in enumerate(templates):
        ranks = in_order(text, order)
        need = needed(len(ranks), threshold)
        out += [(r, t, i, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    return out


def candidates(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """blocks: file_key, row_at, at, ranks (places of a block's template words in the order, rising). One row for each block and template that share a prefix word,
    with long_enough (length filter) and bound: how many words they can share at most, counted from the first word that both hold (positional filter)."""
    hits = blocks.select("*", F.posexplode("ranks").alias("j", "rank")).join(index, "rank")
    first = hits.groupBy("file_key", "row_at", "at", "template", "size", "need").agg(F.min(F.struct("j", "i")).alias("hit"), F.any_value("ranks").alias("ranks"))
    left = F.least(F.col("size") - F.col("hit.i"), F.size("ranks") - F.col("hit.j"))
    return first.select("file_key", "row_at", "at", "template", "size", "need", "ranks", (F.size("ranks") >= F.col("need")).alias("long_enough"), left.alias("bound"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = with_locator(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), "file_key", "row_at")

    # The order: in how many documents each template word occurs. At most as many rows as the templates have words.
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    held = rows.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    index_rows = template_index(order, templates, threshold)
    index = F.broadcast(spark.createDataFrame(index_rows, "rank bigint, template int, i int, size int, need int"))
    prefix, ordered = F.array(*[F.lit(order[r - 1]) for r in sorted({r for r, *_ in index_rows})]), F.array(*map(F.lit, order))

    def of_words(words: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        found = {p: F.when(joined.contains(f" {p} "), places(words, p)).otherwise(F.array().cast("array<int>")) for p in phrases}
        some = lambda s: F.slice(words, s + 1, BLOCK)
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(STEP))
        tokens = F.transform(starts, lambda s: F.struct(s.alias("at"), F.array_distinct(some(s)).alias("tokens")))
        ranks = lambda tokens: F.array_sort(F.filter(F.transform(tokens, lambda t: F.array_position(ordered, t)), lambda r: r > 0))
        blocks = F.transform(F.filter(tokens, lambda b: F.arrays_overlap(b["tokens"], prefix)), lambda b: F.struct(b["at"].alias("at"), ranks(b["tokens"]).alias("ranks")))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.array(*[F.struct(F.lit(label).alias("label"), found[p].alias("at")) for p, label in phrases.items()]).alias("base"),
            F.when(F.arrays_overlap(words, prefix), blocks).otherwise(F.array().cast("array<struct<at:int,ranks:array<bigint>>>")).alias("blocks"),
        )

    read = written(rows.select("doc_id", "file_key", "row_at", let(words_of(F.col("text")), of_words).alias("s")).select("doc_id", "file_key", "row_at", "s.*"), "blocks")

    each = read.where(F.size("blocks") > 0).select("file_key", "row_at", F.explode("blocks").alias("b")).select("file_key", "row_at", "b.at", "b.ranks")
    asked = candidates(each, index).where(F.col("long_enough") & (F.col("bound") >= F.col("need")))
    arrays = lambda i: F.array(*[F.array(*[F.lit(r).cast("bigint") for r in in_order(t[i], order)]) for t in templates])
    named = F.size(F.array_except(F.get(arrays(2), F.col("template")), "ranks")) == 0
    label = F.get(F.array(*[F.lit(t[0]) for t in templates]), F.col("template"))
    counted = asked.withColumns({"shared": F.size(F.array_intersect("ranks", F.get(arrays(1), F.col("template")))), "label": label}).where((F.col("shared") >= F.col("need")) & named)
    method = counted.groupBy("file_key", "row_at").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("containment"))
    method = written(method.select(F.col("file_key").alias("f"), F.col("row_at").alias("r"), "found", "containment"), "templates")
    method = small_or_not(method, method.count(), 120)

    at = F.flatten(F.transform("base", lambda b: b["at"]))
    base_labels = F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])))
    joined = read.select("doc_id", "file_key", "row_at", "n_words", at.alias("at"), base_labels.alias("base_labels")).join(method, (F.col("file_key") == F.col("f")) & (F.col("row_at") == F.col("r")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("at").cast("bigint").alias("n_base"),
        F.array_min("at").cast("bigint").alias("first_word"),
        F.array_max("at").cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
