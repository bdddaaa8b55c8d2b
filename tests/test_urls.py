from urllib.parse import parse_qsl, quote, urlencode, urlparse, urlunparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import urls as U

CASES = [
    ("HTTPS://EXAMPLE.COM/docs/page/", "https://example.com/docs/page"),
    ("https://e.com/page?utm_source=1&b=2", "https://e.com/page?b=2"),
    ("http://e.com:80/docs/page", "http://e.com/docs/page"),
    ("https://e.com:443", "https://e.com/"),
    ("https://e.com/a?b=2&a=1#top", "https://e.com/a?a=1&b=2"),
    ("https://e.com/a?a&b=%20x+y~*", "https://e.com/a?a=&b=+x+y~%2A"),
    ("https://e.com/a?q=%zz", "https://e.com/a?q=%25zz"),
    ("https://u:P@E.com//a//", "https://u:p@e.com//a"),
]


def model(url, prefixes=("utm_",)):
    p = urlparse(url)
    path = p.path or "/"  # parameters (;...) stand apart from the path; a path of several slashes becomes empty
    path = path if path == "/" else path.rstrip("/")
    netloc = p.netloc.lower().removesuffix({"http": ":80", "https": ":443"}.get(p.scheme, "\0"))
    pairs = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.startswith(prefixes))
    return urlunparse(p._replace(netloc=netloc, path=path, fragment="", query=urlencode(pairs)))


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string").select("i", expr(F.col("u")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_normalize(spark):
    got = column(spark, [a for a, _ in CASES], lambda u: U.normalize_url(u, (), ("utm_",)))
    assert got == [b for _, b in CASES] == [model(a) for a, _ in CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abAB./ é~*;", max_size=12), st.lists(st.tuples(st.text("abu_tm é+%&", max_size=5), st.text("xy +=é~*", max_size=5)), max_size=3)), min_size=1, max_size=20))
def test_normalize_like_the_standard_library(spark, parts):
    urls = ["https://Example.com/" + quote(p, safe="/;~*") + ("?" + urlencode(q) if q else "") for p, q in parts]
    assert column(spark, urls, lambda u: U.normalize_url(u, (), ("utm_",))) == [model(u) for u in urls]


@pytest.mark.parametrize(("url", "ext"), [("https://e.com/a/b.PDF?x=.gif", ".pdf"), ("https://e.com/a.b/c", ""), ("https://e.com/.hidden", ""), ("https://e.com/x.tar.gz", ".gz"), ("https://e.com/", ""), ("https://e.com/..a.b", ".b")])
def test_extension(spark, url, ext):
    assert column(spark, [url], U.extension) == [ext]


def test_segments(spark):
    names = ["a%20b", ".", "", "con", "a:b", "x" * 130, "a+b", " %20 "]
    got = column(spark, names, U.sanitize_segment)
    assert got[:5] == ["a b", "_", "_", "_con_", "a_b"] and len(got[5]) == 89 and got[6:] == ["a+b", "_"]


def test_paths(spark):
    assert column(spark, ["https://e.com/", "https://e.com/a/b?x=1"], U.relative_path) == ["index", "a/b__q_" + __import__("hashlib").sha1(b"x=1").hexdigest()[:8]]
    base = lambda u: U.relative_path_from(u, "https://e.com/services/canvas", "canvas")
    assert column(spark, ["https://e.com/services/canvas", "https://e.com/services/canvas/x", "https://e.com/services/canvas2"], base) == ["canvas", "x", "services/canvas2"]
    assert column(spark, ["https://e.com/a?utm_x=1"], lambda u: U.query_suffix(u, (), ("utm_",))) == ["__q_da39a3ee"]
    assert column(spark, ["a.md", "a.md.txt", "a"], U.md_name) == ["a.md", "a.md.txt", "a.md"]
    assert column(spark, ["a.md", "a.md.txt"], U.html_path) == ["a.html", "a.html"]


def test_scopes():
    assert [U.crawl_scope(u) for u in ("https://e.com", "https://e.com/docs/", "https://e.com/docs", "https://e.com/docs/index.html", "https://e.com/a/b")] == ["/", "/docs", "/docs", "/docs", "/a"]
    assert U.candidate_bases("https://e.com/a/b/c") == ["https://e.com/a/b", "https://e.com/a", "https://e.com"]


def test_resolve_like_urljoin(spark):
    """Random references against random bases, all in two jobs."""
    import itertools
    import random
    from urllib.parse import urljoin

    from corpusloom.plans.crawl import resolve

    bases = ["https://e.com", "https://e.com/", "https://e.com/a", "https://e.com/a/b/c/d", "https://e.com/a/b/", "http://e.com:8080/a/b;p?q=1#f", "https://e.com//a//b", "https://e.com/a/./b/../c"]
    hrefs = ["", "?p=2", "#x", "?p=2#x", ".", "..", "./", "../", "/", "/x/../y", "././z", "../../x", "../../../../x/", "x//y", "/x//y/", "//o.com/z/../w", "//o.com", "http://o.com/../a", "HTTPS://e.com/A/../b", "https:x", "https:/y", "mailto:a@b", "x;p", ";p", "x?y#z", "x/./y/../", "..x", "x..", " x", "a\tb", "é/ü", "x?", "x#", "%2e%2e/x"]
    rng = random.Random(3)
    hrefs += ["".join(rng.choice(["a", ".", "..", "/", "?", "#", ";", "b"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    pairs = [(b, h) for b, h in itertools.product(bases, hrefs)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b string, h string").select("i", resolve(F.col("b"), F.col("h")).alias("u")).collect()
    wrong = [(pairs[r["i"]], r["u"], urljoin(*pairs[r["i"]])) for r in rows if r["u"] != urljoin(*pairs[r["i"]])]
    assert wrong == []


def test_relative_to(spark):
    from corpusloom.functions.urls import relative_to

    rows = spark.createDataFrame([("out/a/b.md",), ("outer/a.md",), (None,)], "p string").select(relative_to(F.col("p"), "out/").alias("r")).collect()
    assert [r["r"] for r in rows] == ["a/b.md", "outer/a.md", None]
