import json
import re
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import licenses as L
from corpusloom.llm import quality as Q
from corpusloom.llm import tool_calls as TC
from corpusloom.llm import url_filter as UF
from corpusloom.llm import winnow as W

from ..oracle import same
from .conftest import EDGE


# -- Quality -------------------------------------------------------------------------------------------------------------------------


def test_op3_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op3_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    both = got.join(labels, how="inner")
    both = both[both["held_out"]]
    assert (both["predicted"] == both["quality"]).mean() >= 0.97
    assert got["score"].between(0, 1).all() and len(got) == 1000


def test_op3_cosines_are_exact(spark, docs, sf_dir):
    model = Q.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), per_class=20, latent=8, neighbours=5)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    z = model.latent(texts)
    for text_vector, score in zip(z, model.scores(texts), strict=True):
        near = model.vectors @ text_vector
        top = np.argsort(-near, kind="stable")[:5]
        w = np.clip(near[top], 0, 1).astype(float) ** model.sharpness
        assert score == pytest.approx((w * model.votes[top, 1]).sum() / (w * model.votes[top].sum(axis=1)).sum(), abs=1e-3)


def test_op3_axes_are_those_of_a_dense_decomposition(spark, docs, sf_dir):
    """On a small sample the fitted space holds what the first singular vectors of a dense decomposition hold."""
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((60, 12)) * 2.0 ** -np.arange(12)) @ rng.standard_normal((12, 300)) + 1e-3 * rng.standard_normal((60, 300))
    want = np.linalg.svd(x.astype(np.float64), full_matrices=False)[2][:6].T
    got = Q.latent_axes(x.astype(np.float32), 6)
    assert np.allclose(np.linalg.svd(want.T @ got, compute_uv=False), 1, atol=1e-3)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = (Q.fit(d, labels, per_class=20, latent=8) for d in (docs, docs.unionByName(docs.limit(0)).repartition(3)))
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    assert np.allclose(a.scores(texts), b.scores(texts), atol=1e-6)


def test_op3_terms_of_brute_force():
    text = "The cat, the Cat, the cat the the"
    tokens = ["The", "cat", ",", "the", "Cat", ",", "the", "cat", "the", "the"]
    terms, shares = Q.term_counts(text)
    back = [0, 0, 0, 0, 0, 3, 3, 6, 2, 1]  # 0: never before
    got = dict(zip(terms.tolist(), (shares.astype(float) ** 2 * len(tokens)).round(4).tolist(), strict=True))
    assert {t - Q.WORDS: n for t, n in got.items() if t >= Q.WORDS} == {0: 5, 2: 3, 3: 1, 1: 1} and sum(b == 0 for b in back) == 5
    assert sum(n for t, n in got.items() if t < Q.WORDS) == len(tokens)
    assert len(Q.term_counts(" \n")[0]) == 0


def test_op3_repeated_ids_are_determined(spark):
    rows = [(i % 7, f"text {i} " * (i % 5)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id bigint, quality int, toxic int")
    one, other = (Q.fit(spark.createDataFrame(r, "doc_id bigint, text string").repartition(3), labels, per_class=4) for r in (rows, rows[::-1]))
    assert np.allclose(one.scores([t for _, t in rows]), other.scores([t for _, t in rows]), atol=1e-6)


def test_op3_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1, None), (5, 0, None), (None, 1, None), (9, None, 0), (9, 1, 0), (9, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        out = Q.scored(edge, Q.fit(edge, table)).collect()
        assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert Q.good_documents(edge, labels).columns == edge.columns
    assert Q.scored(nothing, Q.fit(nothing, labels)).collect() == []
    one = spark.createDataFrame([(None,), (7,)], "doc_id bigint").select(Q.held_out(F.col("doc_id")).alias("h")).collect()
    import zlib

    assert [r["h"] for r in one] == [True, zlib.crc32(b"7") % 5 == 0]


# -- Winnowing -------------------------------------------------------------------------------------------------------------------------


def units_of(text):
    """Units and the places of their first characters, by a plain reading of the rules."""
    alone = lambda c: 0xE00 <= ord(c) <= 0x109F or 0x1780 <= ord(c) <= 0x17FF or 0x2E80 <= ord(c) <= 0xABFF or ord(c) >= 0xF900
    out, now = [], ""
    for i, c in enumerate(text):
        if alone(c):
            out.extend([(now, i - len(now))] if now else [])
            out.append((c, i))
            now = ""
            continue
        now += c
        if c in W.CUT or len(now) == W.LONGEST:
            out.append((now, i + 1 - len(now)))
            now = ""
    return [*out, (now, len(text) - len(now))] if now else out


def brute_prints(text):
    """(hash, place) of the prints, by windows one after another."""
    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    turn = lambda h, by: (h << by | h >> 64 - by) & (1 << 64) - 1 if by else h
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    units = units_of(text)
    if len(units) < W.GRAM:
        return [(digest(text), 0)]
    grams = []
    for i in range(len(units) - W.GRAM + 1):
        h = 0
        for u, _ in units[i : i + W.GRAM]:
            h = turn(h, 1) ^ digest(u)  # rolls on
        grams.append(h)
    kept = {}
    for end in range(len(grams) + W.WINDOW - 1):
        kept[min(range(max(0, end - W.WINDOW + 1), min(end + 1, len(grams))), key=lambda i: (signed(grams[i]) >> 31, -i))] = None
    return [(grams[i], units[i][1]) for i in kept]


def shown(prints):
    return ",".join(f"{h:x}@{i:x}" for h, i in prints)


def test_op4_against_brute_force(spark, docs):
    texts = dict(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    ids = list(texts)
    got = W.fingerprints(docs).select("doc_id", "n_chars", "edited", W.as_string(F.col("prints")).alias("p"), W.as_string(F.col("edited_prints")).alias("e"), "next_hashes").collect()
    assert sorted(r["doc_id"] for r in got) == ids
    for r in got:
        text, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert (r["n_chars"], r["edited"]) == (len(text), edited)
        assert r["p"] == shown(brute_prints(text)) and r["e"] == shown(brute_prints(edited))
        assert sorted(h & (1 << 64) - 1 for h in r["next_hashes"]) == sorted({h for h, _ in brute_prints(after)})


def test_op4_query_and_edges(spark, edge, nothing, sf_dir):
    out = W.op4_document_fingerprints(spark, sf_dir).toPandas()
    assert out["near_edited"].between(0, 1).all() and out["near_edited"].mean() > 0.4 and out["near_next"].mean() < 0.1
    rows = W.fingerprints(edge).select("doc_id", "n_chars", W.as_string(F.col("prints")).alias("p")).collect()
    assert len(rows) == len(EDGE) and sorted(r["n_chars"] for r in rows) == sorted(len(t or "") for _, t in EDGE)
    assert sorted(r["p"] for r in rows) == sorted(shown(brute_prints(t or "")) for _, t in EDGE)
    assert W.fingerprints(nothing).collect() == []
    one = W.fingerprints(edge.where("doc_id = 9")).first()
    assert one["edited"] == "that ith"


def test_op4_next_across_ranges(spark, monkeypatch):
    """With nearly a range for each row, with rows of one doc_id and of none, every row has its next; ranges are found in two steps."""
    rows = [(None if i < 5 else 7 if i < 17 else i, f"text {i} " + "xyz " * i) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = W.fingerprints(frame).select("doc_id", "n_chars", "edited").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    want = []
    # Rows of one doc_id stand in the order of the table as it was written; their texts tell which that is.
    placed = [r["text"] for r in frame.collect()]
    order = sorted(range(40), key=lambda i: (-1 if rows[i][0] is None else rows[i][0], placed.index(rows[i][1])))
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        text, after = rows[i][1], rows[j][1]
        quarter = len(text) // 4
        want.append((len(text), text[: len(text) - quarter] + after[:quarter]))
    assert sorted((r["n_chars"], r["edited"]) for r in got) == sorted(want)


def test_op4_prints_of_any_text(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abmzAM059 \n\t日本ไü😀.x"), int(n))) for n in rng.integers(0, 150, 400)] + ["z" * 200 + "m" + "z" * 65, ""]
    got = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", W.as_string(W.winnowed(F.col("t"))).alias("p")).collect()}
    assert all(got[t] == shown(brute_prints(t)) for t in texts)


def prints_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", W.winnowed(F.col("t")).alias("p")).orderBy("i").collect()
    return [{(p["hash"], p["at"]) for p in r["p"]} for r in rows]


def test_op4_match_guarantee(spark):
    """Two texts that share GRAM + WINDOW - 1 units share a print, and its places locate the match in the characters."""
    shared = "m".join(c * 9 for c in "bcdfhijk"[: W.GRAM + W.WINDOW - 1]) + "m"
    texts = [f"{i} {i * 7}  m{shared} {i * 3} {i}" for i in range(30)]
    found = prints_of(spark, texts)
    common = set.intersection(*({h for h, _ in p} for p in found))
    assert common
    for text, p in zip(texts, found, strict=True):
        for h, at in p:
            if h in common:
                assert text[at : at + 20] in shared


@pytest.mark.parametrize("kind", ["han", "base64", "thai"])
def test_op4_shifted_copies_without_spaces(spark, kind):
    """One character before a text without spaces leaves all but its first prints the same."""
    rng = np.random.default_rng(9)
    letters = {"han": [chr(c) for c in range(0x4E00, 0x5200)], "base64": list(string.ascii_letters + string.digits + "+/"), "thai": [chr(c) for c in range(0xE01, 0xE2F)]}[kind]
    text = "".join(rng.choice(letters, 4000))
    one, other = prints_of(spark, [text, letters[3] + text])
    a, b = {h for h, _ in one}, {h for h, _ in other}
    assert len(a & b) / len(a | b) > 0.95
    assert sum((h, at + 1) in other for h, at in one) >= 0.95 * len(one)


# -- Licenses --------------------------------------------------------------------------------------------------------------------------


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    at, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    both, best = set(labels), 0.0
    for s in range(0, max(1, len(words)), L.STEP):
        block = set(words[s : s + L.BLOCK])
        for label, template, names in L.TEMPLATES:
            t = set(template.split())
            if len(t & block) >= L.needed(len(t), L.THRESHOLD) and set(names.split()) <= block:
                both.add(label)
                best = max(best, len(t & block) / len(t))
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), 1.0 if at else best


@pytest.mark.parametrize("source", ["docs", "edge", "memory_edge"])
def test_op5_against_brute_force(request, source):
    frame = request.getfixturevalue(source)
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted(repr((r["doc_id"], *(r[c] for c in columns))) for r in L.scan(frame).collect())
    assert got == sorted(repr((r["doc_id"], *brute_licenses(r["text"]))) for r in frame.select("doc_id", "text").collect())


def test_op5_finds_templates_and_phrases(spark, nothing):
    texts = ["x " * 100 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated docs", "CC-BY-NC; under the MIT license, under the mit license", "the apache license"]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert (got[0]["labels"], got[0]["base_labels"], got[0]["n_base"]) == ("mit", "", 0) and 0.8 <= got[0]["score"] < 1
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 7, "cc-by-nc,mit")
    assert (got[2]["labels"], got[2]["score"]) == ("", 0.0)
    assert L.scan(nothing).collect() == []


def test_op5_filters_reject_rows_and_lose_none(spark):
    """Random blocks of template words: the length and the positional filter both reject candidates, and none that holds enough words."""
    rng = np.random.default_rng(8)
    order = sorted({w for _, t, _ in L.TEMPLATES for w in t.split()}, key=lambda w: (len(w) * 7 % 11, w))
    index_rows = L.template_index(order, L.TEMPLATES, L.THRESHOLD)
    rows = []
    for i in range(600):
        words = set(rng.choice(order, int(rng.integers(1, 30)), replace=False))
        template = L.TEMPLATES[i % len(L.TEMPLATES)][1].split()
        words |= set(rng.choice(template, int(rng.integers(0, len(template) + 1)), replace=False))
        rows.append((0, i, 0, L.in_order(" ".join(words), order)))
    blocks = spark.createDataFrame(rows, "file_key bigint, row_at bigint, at int, ranks array<bigint>")
    got = L.candidates(blocks, spark.createDataFrame(index_rows, "rank bigint, template int, i int, size int, need int")).collect()
    enough = {(i, t) for _, i, _, ranks in rows for t, (_, text, _) in enumerate(L.TEMPLATES) if len(set(ranks) & set(L.in_order(text, order))) >= L.needed(len(set(text.split())), L.THRESHOLD)}
    kept = {(r["row_at"], r["template"]) for r in got if r["long_enough"] and r["bound"] >= r["need"]}
    assert len(got) == len({(r["row_at"], r["template"]) for r in got})  # each block and template once
    assert sum(not r["long_enough"] for r in got) > 50 and sum(r["long_enough"] and r["bound"] < r["need"] for r in got) > 50
    assert enough <= kept and len(enough) > 100


@pytest.mark.parametrize("text", ["This program is released under the GNU license", "The song was released under the new license", "the license under which 2 0 versions of the file are licensed"])
def test_op5_no_label_without_its_name(spark, text):
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (got["labels"], got["score"]) == ("", 0.0)


# -- Chats -----------------------------------------------------------------------------------------------------------------------------


def test_op8_against_sql(spark, sf_dir):
    same(spark, sf_dir, TC.op8_tool_call_linking, TC.OP8_SQL)


def test_op8_links_orders_and_validates(spark):
    args = lambda **k: json.dumps(k)
    calls = spark.createDataFrame(
        [
            ("a", None, "reply", args(turn=1, prompt="é\n\"x\""), 1, 0), ("b", "a", "reply", args(prompt="", turn=1), 1, 2), ("c", "b", "reply", args(prompt="p", turn="1"), 1, 4), ("d", "c", "other", "{}", 1, 6),
            ("e", "f", "reply", "{bad", 2, 0), ("f", "e", "reply", None, 2, 2), ("g", "nowhere", "reply", args(prompt="p", turn=3, more=1), 2, 4), ("a", None, "reply", args(turn=1, prompt="é\n\"x\""), 1, 0),
        ],
        "call_id string, after string, name string, arguments string, conv_id bigint, turn bigint",
    )
    results = spark.createDataFrame([("a", "r", 1, 1), ("z", None, 3, 1)], "call_id string, content string, conv_id bigint, turn bigint")
    got = {r["call_id"]: r for r in TC.link(calls, results, TC.CHAT_SCHEMAS).collect()}
    assert {k: r["ordinal"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None, "f": None, "g": 0, "z": None}
    assert {k for k, r in got.items() if r["valid"]} == {"a"} and got["z"]["valid"] is None
    assert got["a"]["copies"] == 2 and got["a"]["linked"] and got["z"]["kind"] == "orphan"
    assert got["a"]["json"] == '{"arguments":{"prompt":"é\\n\\"x\\"","turn":1},"id":"a","name":"reply","ordinal":0,"result":"r","valid":true}'
    assert json.loads(got["e"]["json"])["arguments"] is None


def test_op8_orders_a_graph(spark):
    """A diamond, a long chain into it, a call with predecessors of different depth, a cycle and what comes after it; against plain recursion."""
    before = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "e": ["d"], "f": ["e", "a", None], "g": ["f", "d", "unknown"], "x": ["y", "a"], "y": ["x"], "z": ["y", "d"], "w": ["z"], "self": ["self"], "one": ["gone"]}
    before |= {f"k{i}": [f"k{i - 1}"] if i else [] for i in range(30)} | {"m": ["k29", "d"], "n": ["m", "k3"], "o": ["n"]}

    def depth(c, seen=()):
        if c in seen:
            return None
        found = [depth(p, (*seen, c)) for p in before[c] if p in before]
        return None if None in found else 1 + max(found) if found else 0

    calls = spark.createDataFrame(list(before.items()), "call_id string, after array<string>")
    got = {r["call_id"]: r["ordinal"] for r in TC.ordinals(calls).collect()}
    assert got == {c: depth(c) for c in before} and got["d"] == 2 and got["m"] == 30 and got["o"] == 32 and got["w"] is None


def test_op8_canonical_numbers_and_long_texts(spark):
    text = "x" * 300_000
    calls = [("a", None, "reply", '{ "turn" : 1, "prompt" : "\\u00e9\\/" }', 1, 0), ("b", None, "t", '{"y":1e2,"x":[1.50,1,true,null]}', 1, 1), ("c", None, "reply", json.dumps({"prompt": text, "turn": 2}), 1, 2)]
    rows = spark.createDataFrame(calls, "call_id string, after string, name string, arguments string, conv_id bigint, turn bigint")
    got = {r["call_id"]: r for r in TC.link(rows, spark.createDataFrame([], "call_id string, content string, conv_id bigint, turn bigint"), TC.CHAT_SCHEMAS).collect()}
    assert got["a"]["json"].startswith('{"arguments":{"prompt":"é/","turn":1},') and got["a"]["valid"]
    assert got["b"]["json"].startswith('{"arguments":{"x":[1.5,1,true,null],"y":100.0},')
    assert got["c"]["valid"] and json.loads(got["c"]["json"])["arguments"]["prompt"] == text


def test_op8_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, call_id string, json string"
    rows = [(1, 0, "user", None, "x", "y"), (1, 1, "assistant", "a", None, None), (1, 1, "assistant", "a", None, None), (None, 0, "user", "t", None, None), (1, None, "assistant", "t", None, None), (2, 0, None, "t", None, None), (2, 0, None, "t", None, None), (3, 5, "assistant", "", None, None)]
    got = TC.chat_records(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["kind"], r["copies"]) for r in got) == [("call", 1), ("context", 1), ("context", 1), ("context", 2), ("orphan", 1)]
    assert TC.chat_records(spark.createDataFrame([], schema)).collect() == []


# -- URLs ------------------------------------------------------------------------------------------------------------------------------


def test_op9_against_sql(spark, sf_dir):
    same(spark, sf_dir, UF.op9_url_filter, UF.OP9_SQL)


def test_op9_edges(spark):
    schema = "page_id bigint, url string, html string, host string, rule string, n bigint"
    urls = [None, "", "nothing", "https://A.Example.NET/en/x", "https://x.net", "https://x.net/", "http://example.com/de/", "http://notexample.com/de/", "a://b.org?x=/fr/", "a://b.org/fr/#://c", "http://u@h:80/p", "http://x.org/é b"]
    got = {r["page_id"]: r for r in UF.judged(spark.createDataFrame([(i, u, None, "h", "r", 1) for i, u in enumerate(urls)], schema)).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"), ("x.net", "", None), ("x.net", "/", "net/"), ("example.com", "/de/", "example.com/de/"),
        ("notexample.com", "/de/", None), ("b.org", "", None), ("b.org", "/fr/", "org/fr/"), ("u@h:80", "/p", None), ("x.org", "/é b", None),
    ]
    assert got[0]["verdict"] == "allow" and got[5]["verdict"] == "block"
    assert UF.judged(spark.createDataFrame([], schema)).collect() == []


def test_op9_beta_mass():
    """Against a fine numeric integration, over angles."""
    x = (np.arange(400_000) + 0.5) * np.pi / 800_000
    for a, b in ((0.7, 0.9), (1, 1), (3.5, 20), (40, 3), (200, 800), (5000, 400)):
        f = (2 * a - 1) * np.log(np.sin(x)) + (2 * b - 1) * np.log(np.cos(x))
        f = np.exp(f - f.max())
        for at in (0.05, 0.2, 0.5, 0.93):
            assert UF.beta_below(np.array([a]), np.array([b]), at)[0] == pytest.approx(f[np.sin(x) ** 2 <= at].sum() / f.sum(), abs=1e-4)


def test_op9_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "com": ("com", "com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "u@h.org:80": ("h.org", "org"), "[::1]:8": ("[::1]", "[::1]")}
    got = {r["host"]: (r["domain"], r["suffix"]) for r in UF.with_site(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == hosts


def brute_above(outcomes, tolerated=UF.TOLERATED):
    """Posterior mass above the tolerated share of each host x.domain.suffix, each level counted without the one below it."""
    import collections
    import math

    n, b, hosts = collections.Counter(), collections.Counter(), sorted({h for h, _ in outcomes})
    for host, bad in outcomes:
        for level in (host, ".".join(host.split(".")[-2:]) + "/d", host.split(".")[-1] + "/s", "all"):
            n[level] += 1
            b[level] += bad
    up_of = {h: (h, ".".join(h.split(".")[-2:]) + "/d", h.split(".")[-1] + "/s", "all") for h in hosts}

    def strength(low):
        """Of level low (0: hosts) below level low + 1."""
        units = {(up_of[h][low], up_of[h][low + 1]) for h in hosts}
        w = m = v = 0.0
        for up in {u for _, u in units}:
            below = [x for x, u in units if u == up]
            r = (b[up] + 0.5) / (n[up] + 1)
            weight = n[up] - sum(n[x] ** 2 for x in below) / n[up]
            w, m = w + weight, m + weight * r * (1 - r)
            v += sum(n[x] * (b[x] / n[x] - b[up] / n[up]) ** 2 for x in below) - (len(below) - 1) * r * (1 - r)
        return min(max(m / max(v, 1e-6 * w) - 1, 1), 100) if w > 1e-9 else 1

    ks, out = [strength(2), strength(1), strength(0)], {}
    for h in hosts:
        rate, levels = (b["all"] + 0.5) / (n["all"] + 1), up_of[h][::-1]
        for k, up, low in zip(ks, levels, levels[1:], strict=False):
            rate = (b[up] - b[low] + k * rate) / (n[up] - n[low] + k)
        a, z = b[h] + k * rate, n[h] - b[h] + k * (1 - rate)
        x = (np.arange(100_000) + 0.5) * math.pi / 200_000
        f = np.exp((2 * a - 1) * np.log(np.sin(x)) + (2 * z - 1) * np.log(np.cos(x)) + math.lgamma(a + z) - math.lgamma(a) - math.lgamma(z)) * math.pi / 100_000
        above = np.sin(x) ** 2 > tolerated  # summed on the side where the density is smooth
        out[h] = f[above].sum() if a < z else 1 - f[~above].sum()
    return out


def test_op9_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{i}.d{i % 5}.{'com' if i % 2 else 'org'}", int(rng.random() < (0.6 if i % 5 == 1 else 0.05))) for i in range(40) for _ in range(int(rng.integers(1, 30)))]
    got = {r["site"]: r["above"] for r in UF.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    want = brute_above(rows)
    assert got.keys() == want.keys() and max(abs(got[h] - want[h]) for h in want) < 2e-3


def test_op9_reputation_changes_verdicts_both_ways(spark):
    """Verdicts follow what pages hold, not what hosts are called: a single bad page on a clean domain is forgiven, a single clean page on a bad domain
    isn't, and many pages of its own free a site again."""
    bad, good = "<p>WIN!! now", "<p>fine"
    rows = [(f"http://s{i}.bad.com/{j}", bad if (i + j) % 5 < 3 else good) for i in range(40) for j in range(15)] + [("http://new.bad.com/1", good)] + [(f"http://large.bad.com/{j}", good) for j in range(60)]
    rows += [(f"http://s{i}.good.com/{j}", good) for i in range(12) for j in range(15)] + [("http://new.good.com/1", bad), ("http://casino-spam.good.com/1", good)]
    rows += [(f"http://h{i}.d{i}.org/{j}", bad if (i + j) % 9 == 0 else good) for i in range(40) for j in range(9)]
    got = {r["host"]: r["verdict"] for r in UF.judged(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string"), rules=[]).collect()}
    assert (got["s1.bad.com"], got["new.bad.com"], got["large.bad.com"]) == ("block", "block", "allow")
    assert (got["s1.good.com"], got["new.good.com"], got["casino-spam.good.com"]) == ("allow", "allow", "allow")
    assert all(v == "allow" for h, v in got.items() if h.endswith(".org"))


def test_op9_repeated_rows_ties_and_long_urls(spark):
    long = "http://h.com/" + "a/" * 200_000 + "?q#f"
    rows = [(1, long, None), (1, long, None), (2, "http://x.example.net/en/", "!!" * 100_000), (3, "http://example.net/en/", "")]
    got = UF.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rules=[*UF.RULES, ("block", "example.net", "/en/")]).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3] and {r["verdict"] for r in got if r["page_id"] > 1} == {"block"}
    assert {len(r["path"]) for r in got if r["page_id"] == 1} == {400_001}
