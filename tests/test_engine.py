import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom import config as cfg
from corpusloom.functions import content as C
from corpusloom.functions import html as H
from corpusloom.operators import fetch as D
from corpusloom.operators import robots as R
from corpusloom.operators import urls as O
from corpusloom.plans import crawl as CR
from corpusloom.plans import pipeline as P
from corpusloom.plans import views as V
from corpusloom.schema import FETCH_SCHEMA, in_domain
from corpusloom.sources import discovery as DI
from corpusloom.sources import manifest as M
from corpusloom.streaming import ledger


def responses(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in FETCH_SCHEMA) for r in rows], FETCH_SCHEMA)


HTML = {"html_status": 200, "html_content_type": "text/html", "html_body": "<html><body><h1>T</h1><p>x</p></body></html>"}


@pytest.mark.parametrize(
    ("row", "config", "want"),
    [
        ({"md_status": 304}, {}, 1),
        ({"md_status": 200, "md_content_length": 99, "md_body": "x"}, {"max_body_bytes": 10}, 2),
        ({"md_status": 200, "md_content_type": "text/markdown", "md_body": ""}, {}, 3),
        ({"md_error": "boom", "md_error_kind": "timeout"}, {"html_fallback": False}, 4),
        ({"md_status": 200, "md_content_type": "application/pdf", "md_body": "x"}, {"html_fallback": False}, 5),
        ({"md_status": 200, "md_content_type": "text/html", "md_body": "<html>"}, {"html_fallback": False}, 6),
        ({"md_status": 404}, {"html_fallback": False}, 7),
        ({"url": "https://e.com/x.pdf", "md_status": 404}, {}, 8),
        ({"md_status": 404, **HTML, "html_content_length": 99}, {"max_body_bytes": 50}, 9),
        ({"md_status": 404, "html_error": "x"}, {}, 10),
        ({"md_status": 404, "html_status": 304}, {}, 11),
        ({"md_status": 404, **HTML, "html_status": 404, "html_content_type": "application/json"}, {}, 12),
        ({"md_status": 404, **HTML, "html_status": 500}, {}, 13),
        ({"md_status": 404, **HTML, "html_content_type": "text/plain", "html_body": "plain"}, {}, 14),
        ({"md_status": 404, **HTML, "html_body": "<html></html>"}, {}, 15),
        ({"md_status": 404, **HTML}, {}, 16),
    ],
)
def test_decision_tree(spark, row, config, want):
    conf = cfg.RunConfig(**config)
    rows = responses(spark, {"url": "https://e.com/x", **row})
    converted = H.page_parts(F.coalesce("html_body", F.lit("")), "auto")["markdown"]
    assert rows.select(D.outcome(conf, converted).alias("o")).first()["o"] == want


def test_run_writes_each_url_once(spark, tmp_path):
    urls = spark.createDataFrame([("https://e.com/a/",), ("https://e.com/a",), ("http://e.com/a",), ("https://e.com/b.pdf",), ("https://e.com/c",), ("https://e.com/d",), ("https://e.com/no",)], "url string")
    conf = cfg.RunConfig(output_dir=str(tmp_path / "out"), max_pages=3)
    answers = responses(spark, {"url": "http://e.com/a", "md_status": 200, "md_content_type": "text/markdown", "md_body": "# Hi\n"}, {"url": "https://e.com/c", "md_status": 404, **HTML})
    run = P.run(urls, answers, conf, run_id="r1", robots_txt="User-agent: *\nDisallow: /d")
    got = {r["url"]: (r["status"], r["note"], r["title"] or r["h1"]) for r in run.manifest.collect()}
    assert got == {
        "http://e.com/a": ("ok", None, "Hi"), "https://e.com/a": ("skipped", "path_collision", None), "https://e.com/b.pdf": ("skipped", "excluded_extension", None),
        "https://e.com/c": ("ok", None, "T"), "https://e.com/d": ("skipped", "robots_disallow", None), "https://e.com/no": ("skipped", "max_pages_limit", None),
    }
    assert run.manifest.where(~in_domain()).isEmpty()
    M.append(run.manifest.drop("stage_ord"), str(tmp_path / "ledger"))
    M.append(run.manifest.drop("stage_ord").withColumn("run_id", F.lit("r2")), str(tmp_path / "ledger"))
    assert M.read(spark, str(tmp_path / "ledger")).count() == 12
    ledger.stream_summary(ledger.ledger_stream(spark, str(tmp_path / "ledger")), str(tmp_path / "state"), str(tmp_path / "counts"))
    batch = {(r["dimension"], r["key"]): r["count"] for r in V.summary(M.read(spark, str(tmp_path / "ledger"))).collect()}
    assert {(r["dimension"], r["key"]): r["count"] for r in spark.read.parquet(str(tmp_path / "counts")).collect()} == batch
    ledger.new_urls(ledger.ledger_stream(spark, str(tmp_path / "ledger")), str(tmp_path / "state2"), str(tmp_path / "urls"))
    assert spark.read.parquet(str(tmp_path / "urls")).count() == 6
    wrote = M.write_files(run.bodies.select(F.col("out_path").alias("path"), F.col("body").alias("text"))).collect()
    assert all(r["error"] is None for r in wrote) and (tmp_path / "out" / "a.md").read_text() == "# Hi\n"


def test_resume_carries_the_cache(spark):
    urls = spark.createDataFrame([("https://e.com/a",)], "url string")
    cache = spark.createDataFrame([("https://e.com/a", "E1", None, "h")], "url string, etag string, last_modified string, content_hash string")
    row = P.run(urls, responses(spark, {"url": "https://e.com/a", "md_status": 304}), cfg.RunConfig(), cache=cache).manifest.first()
    assert (row["note"], row["etag"], row["content_hash"]) == ("not_modified", "E1", "h")


def test_jsonl_reader_skips_what_is_broken(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"url":"a","status":"ok"}\n\nnot json\n[1]\n{"url":"b"}\n')
    assert [r["url"] for r in M.read_jsonl(spark, str(tmp_path / "m.jsonl")).orderBy("ordinal").collect()] == ["a", "b"]


def payloads(spark, *rows):
    return spark.createDataFrame([(u, 200, t, b) for u, t, b in rows], "url string, status int, content_type string, body binary")


def test_llms(spark):
    text = b"# Docs\nhttps://e.com/docs/a/\n- [B](https://e.com/docs/b) [X](https://other.com/x)\r\n"
    found = DI.llms_urls(payloads(spark, ("https://e.com/llms.txt", "text/plain", text)), "https://E.com/docs")
    assert [r["url"] for r in found.orderBy("pos").collect()] == ["https://e.com/docs/a", "https://e.com/docs/b"]
    assert DI.llms_urls(payloads(spark, ("https://e.com/llms.txt", "text/plain", b"nothing")), "https://e.com").isEmpty()


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {ns}><sitemap><loc>/child.xml.gz</loc></sitemap><sitemap><loc>https://e.com/s.xml</loc></sitemap><sitemap><loc>/bad.xml</loc></sitemap></sitemapindex>".encode()
    child = gzip.compress(f"<urlset {ns}><url><loc> https://e.com/b/ </loc></url><url><loc>a</loc></url><url><loc>https://o.com/x</loc></url></urlset>".encode())
    rows = [("https://e.com/robots.txt", "text/plain", b"Sitemap: https://e.com/s.xml"), ("https://e.com/s.xml", "text/xml", index), ("https://e.com/child.xml.gz", "application/gzip", child), ("https://e.com/bad.xml", "text/xml", b"<oops")]
    assert [r["url"] for r in DI.sitemap_urls(payloads(spark, *rows), "https://e.com").collect()] == ["https://e.com/a", "https://e.com/b"]


def test_search_index(spark):
    data = json.dumps({"docs": [{"url": "/a", "location": "b/"}, {"path": 3}], "url": "/self"}).encode()
    rows = payloads(spark, ("https://e.com/search-index.json", "application/json", data), ("https://e.com/index.json", "application/json", b"{bad"))
    assert [r["url"] for r in DI.search_index_urls(rows, "https://e.com/").collect()] == ["https://e.com/a", "https://e.com/b", "https://e.com/self"]
    assert DI.discover(rows, "https://e.com/")[0] == "search_index"


def test_crawl_is_first_in_first_out(spark, tmp_path):
    page = lambda *hrefs: "<html>" + "".join(f'<a href="{h}">x</a>' for h in hrefs)
    pages = spark.createDataFrame(
        [
            ("https://e.com/docs", 200, "text/html", page("/docs/a", "/docs/b.pdf", "/docs/dir/", "/out", "#x")),
            ("https://e.com/docs/a", 200, "text/html", page("/docs/c", "/docs", "mailto:x@y")),
            ("https://e.com/docs/dir", 200, "text/html", page("/docs/d?b=2&a=1")),
            ("https://e.com/docs/c", 200, "text/plain", "plain"),
            ("https://e.com/docs/d?a=1&b=2", 200, "text/html", page("/docs/deep")),
            ("https://e.com/docs/deep", 200, "text/html", page()),
        ],
        "url string, status int, content_type string, html string",
    )
    run = lambda **k: sorted(r["url"].removeprefix("https://e.com/docs") for r in CR.crawl(pages, cfg.RunConfig(base_url="https://e.com/docs", **k), f"file://{tmp_path}", k.pop("robots", None) if False else None).collect())
    assert run(max_depth=2) == ["", "/a", "/d?a=1&b=2", "/dir"]
    assert run(max_depth=1) == ["", "/a", "/dir"]
    assert run(max_depth=3, max_pages=4) == ["", "/a", "/dir"]  # the text page used the budget
    robots = CR.crawl(pages, cfg.RunConfig(base_url="https://e.com/docs"), f"file://{tmp_path}", "User-agent: *\nDisallow: /docs/dir")
    assert sorted(r["url"] for r in robots.collect()) == ["https://e.com/docs", "https://e.com/docs/a"]


def test_robots():
    groups = R.parse_robots("User-agent: mozilla\nDisallow:\n\nUser-agent: *\nCrawl-delay: 2\nDisallow: /a\nAllow: /a/b")
    assert R.group_for(groups, "Mozilla/5.0")["rules"] == [(True, "")]
    assert R.group_for(groups, "other")["delay"] == 2.0
    assert (R.delayed_rate(5.0, 2.0), R.delayed_rate(0, 2.0), R.delayed_rate(5.0, None)) == (0.5, 0.5, 5.0)


def test_html():
    page = "<html><head><title>A <b>b</b></title></head><body><nav><a href='/n'>n</a></nav><main><h1> Hello <b>World</b></h1><p>One<br>two <a href='/x'>link</a><ul><li>a<ul><li>b</li></ul></li></ul><pre>c\n d</pre><table><tr><th>h</th></tr><tr><td>v</td></tr></table><script>var x='</p>';</script><blockquote>q</blockquote><hr><ol><li>1</li></ol><img alt=i src=s></main></body></html>"
    root = H.parse(page)
    assert H.h1_of(root) == "HelloWorld" and H.links_of(root) == ["/n", "/x"]
    text = H.convert(root, "raw")[0]
    for part in ("# Hello **World**", "One  \ntwo [link](/x)", "- a\n  - b", "```\nc\n d\n```", "| h |\n| --- |\n| v |", "> q", "---", "1. 1", "![i](s)"):
        assert part in text
    assert "var x" not in text and H.convert(H.parse(""), "auto") == (None, "raw")


def test_content(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(C.markdown_h1(F.lit("---\na: # no\n---\r\n\n  # Yes  \n# No"))) == "Yes"
    assert one(C.markdown_h1(F.lit("---\n# hidden"))) is None and one(C.markdown_h1(F.lit(""))) is None
    short = one(C.truncated(F.lit("é" * 60), 51))
    assert len(short.encode()) <= 51 and "[truncated]" in short and set(short.replace("\n...[truncated]...\n", "")) == {"é"}


def test_collisions_limits_quota(spark):
    urls = spark.createDataFrame([(u,) for u in "abcd"], "url string")
    won = O.with_winner(urls, F.when(F.col("url") < "c", "p").otherwise(F.col("url"))).where("url <> winner").collect()
    assert [(r["url"], r["winner"]) for r in won] == [("b", "a")]
    kept = O.first_urls(urls, 2)
    assert sorted(r["url"] for r in O.remainder(urls, kept).collect()) == ["c", "d"]
    sizes = spark.createDataFrame([("r", i, s) for i, s in enumerate([5, 9, 4, 1])], "run_id string, ord bigint, size bigint")
    assert sorted(r["ord"] for r in O.snapshot_quota(sizes, 0, 10).collect()) == [0, 2, 3]
    assert sorted(r["ord"] for r in O.snapshot_quota(sizes, 2).collect()) == [0, 1]


def test_settings(tmp_path):
    (tmp_path / "p.toml").write_text('[profile]\nrate_limit_per_sec = 2.0\nmax_pages = 7\nignore_query_params = "a, b"\nsave_html = "yes"\n[profiles.x]\nmax_pages = 9\n')
    args = lambda *a: cfg.from_args(cfg.parser().parse_args(["https://e.com/docs/canvas", *a]))
    got = args("--profile", str(tmp_path / "p.toml"), "--max-pages", "3", "--header", "A: b", "--exclude-ext", "html,.XML", "--site-root", "auto")
    assert (got.rate_limit_per_sec, got.max_pages, got.ignore_query_params, got.save_html, got.headers, got.site_root) == (2.0, 3, ("a", "b"), True, {"A": "b"}, "canvas")
    assert {".html", ".xml", ".pdf"} <= set(got.exclude_exts) and got.retry_timeout == 4 and got.retry_unknown == 0
    assert args("--profile", str(tmp_path / "p.toml"), "--profile-name", "x").max_pages == 9 and args().max_pages == 5000
    assert cfg.usable_pattern("(") is None and cfg.usable_pattern("") is None and cfg.load_profile("/nowhere") == {}


def test_command_line(spark, tmp_path):
    from corpusloom.cli import main

    spark.createDataFrame([("https://e.com/a",)], "url string").write.parquet(str(tmp_path / "urls"))
    responses(spark, {"url": "https://e.com/a", "md_status": 404, **HTML}).write.parquet(str(tmp_path / "answers"))
    out = str(tmp_path / "out")
    assert main(["https://e.com", "--urls", str(tmp_path / "urls"), "--responses", str(tmp_path / "answers"), "--out", out]) == 0
    report = json.loads((tmp_path / "out/_report/report.json").read_text())
    assert report["ok"] == 1 and (tmp_path / "out/_report/toc.md").exists() and "<table>" in (tmp_path / "out/_report/report.html").read_text()
    assert main(["https://e.com", "--urls", str(tmp_path / "urls"), "--out", out, "--scope-prefix", "/none"]) == 2


def captured_site(spark, tmp_path, **payloads):
    page = lambda *hrefs: "<html><head><title>T</title></head><body><h1>H</h1><p>text</p>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</body></html>"
    html = {"md_status": 404, "html_status": 200, "html_content_type": "text/html"}
    responses(
        spark,
        {"url": "https://e.com/docs", **html, "html_body": page("docs/a", "docs/b", "docs/no/x")},
        {"url": "https://e.com/docs/a", **html, "html_body": page("../docs/c")},
        {"url": "https://e.com/docs/b", "md_status": 404, "md_body": "twin", "html_status": 500, "html_content_type": "text/html", "html_body": "é" * 40},
        {"url": "https://e.com/docs/c", "md_status": 200, "md_content_type": "text/markdown", "md_body": "# C\n", **{k: v for k, v in html.items() if k != "md_status"}, "html_body": page()},
        {"url": "https://e.com/docs/no/x", **html, "html_body": page()},
    ).write.parquet(str(tmp_path / "answers"))
    rows = [(f"https://e.com/{n}", 200, "text/plain", b.encode()) for n, b in {"robots.txt": "User-agent: *\nDisallow: /docs/no", **payloads}.items()]
    spark.createDataFrame(rows, "url string, status int, content_type string, body binary").write.parquet(str(tmp_path / "payloads"))
    return ["https://e.com/docs", "--responses", str(tmp_path / "answers"), "--payloads", str(tmp_path / "payloads"), "--out", str(tmp_path / "out")]


def test_command_line_crawls_where_nothing_is_listed(spark, tmp_path):
    from corpusloom.cli import main

    args = captured_site(spark, tmp_path)
    assert main([*args, "--frontmatter", "--save-html", "--error-snapshot-max-bytes", "50", "--manifest-sorted"]) == 0
    out = tmp_path / "out"
    report = json.loads((out / "_report/report.json").read_text())
    assert (report["discovery_source"], report["ok"], report["filtered_urls"], report["scheduled_urls"]) == ("bfs", 3, 3, 3)
    assert report["status_counts"] == {"ok": 3} and report["extractor_counts"] and report["error_count"] == 0
    text = (out / "docs/a.md").read_text()
    assert text.startswith("---\nsource_url: https://e.com/docs/a\nfetched_url: https://e.com/docs/a\nfetched_at_utc: ") and "# H" in text
    assert (out / "docs/a.html").read_text().startswith("<html>") and not (out / "docs/c.html").exists()  # c's Markdown twin decided
    assert (out / "_report/toc.md").read_text().splitlines() == ["- docs", "  - a.md", "  - c.md", "- docs.md"]
    index = [json.loads(line) for f in sorted((out / "_report/index").glob("*.json")) for line in f.read_text().splitlines()]
    assert [r["out_path"] for r in index] == ["docs.md", "docs/a.md", "docs/c.md"]
    assert (out / "_report/urls.txt").read_text().split() == ["https://e.com/docs", "https://e.com/docs/a", "https://e.com/docs/c"]
    assert not list((out / "_report").glob("_work-*"))


def test_command_line_discovers_and_snapshots(spark, tmp_path):
    from corpusloom.cli import main

    args = captured_site(spark, tmp_path, **{"docs/llms.txt": "# D\n- [b](https://e.com/docs/b)\n- [n](https://e.com/docs/no/x)\nhttps://e.com/docs/a\n"})
    assert main([*args, "--error-snapshot-max-bytes", "50", "--frontmatter", "--frontmatter-no-timestamp"]) == 0
    report = json.loads((tmp_path / "out/_report/report.json").read_text())
    assert (report["discovery_source"], report["total"], report["ok"], report["failed"], report["skipped"]) == ("llms_txt", 3, 1, 1, 1)
    assert report["note_counts"] == {"html_fetch_failed": 1, "robots_disallow": 1} and report["error_kind_counts"] == {"http_5xx": 1}
    (snapshot,) = (tmp_path / "out/_report/_errors").glob("*_html_http.txt")
    assert len(snapshot.read_bytes()) <= 50 and "[truncated]" in snapshot.read_text()
    rows = M.read(spark, str(tmp_path / "out/_report/manifest")).collect()
    assert {r["url"]: r["error_snapshot"] for r in rows if r["error_snapshot"]} == {"https://e.com/docs/b": str(snapshot)}
    assert "fetched_at_utc" not in (tmp_path / "out/docs/a.md").read_text()
    assert main([*args, "--dry-run"]) == 0 and main([*args, "--ignore-robots", "--no-save-error-html", "--out", str(tmp_path / "o2")]) == 0
    again = json.loads((tmp_path / "o2/_report/report.json").read_text())
    assert again["ok"] == 2 and not (tmp_path / "o2/_report/_errors").exists()


def test_snapshots_fall_back_and_keep_to_the_quota(spark):
    rows = responses(spark, *[{"url": f"https://e.com/{i}", "md_status": 404, "md_body": "twin" * i, "html_status": 500 if i else None, "html_content_type": "text/html", "html_body": None} for i in range(5)], {"url": "https://e.com/x", "md_status": 404, "html_error": "boom"})
    urls = rows.select("url")
    paths = lambda **k: {r["url"]: r["error_snapshot"] for r in P.run(urls, rows, cfg.RunConfig(**k), run_id="r").manifest.collect() if r["error_snapshot"]}
    every = paths()
    assert len(every) == 5 and every["https://e.com/x"].endswith("_html_exception.txt") and every["https://e.com/3"].endswith("_markdown_fallback.txt")
    assert len(paths(error_snapshot_max_files=2)) == 2 and paths(save_error_html=False) == {}
    few = P.run(urls, rows, cfg.RunConfig(error_snapshot_max_total_bytes=12), run_id="r")
    assert sum(len(r["text"]) for r in few.snapshots.collect()) <= 12 and few.snapshots.count() >= 1


def test_patterns_of_both_dialects(spark):
    rows = spark.createDataFrame([("https://e.com/aa",), ("https://e.com/ab",), (None,)], "url string")
    for pattern in (r"(?P<n_1>a)(?P=n_1)\Z", r"(a)(?(1)a)$"):
        assert [r["x"] for r in rows.select(F.coalesce(O.found_in(F.col("url"), pattern), F.lit(False)).alias("x")).collect()] == [True, False, False]


def test_every_setting_is_read():
    """But for those of whoever captures, each setting is read by some plan or operator."""
    import dataclasses
    import pathlib

    for_capture = {"max_workers", "request_timeout", "headers", "cookies", "auth", "token", "host_max_concurrency"}
    root = pathlib.Path(cfg.__file__).parent
    text = "".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts and p.name != "queries.py")
    missing = [f.name for f in dataclasses.fields(cfg.RunConfig) if f"config.{f.name}" not in text and f"self.{f.name}" not in text]
    assert set(missing) <= for_capture | {"retry_total", "retry_backoff_base", "retry_backoff_max", "retry_backoff_jitter"}, missing


def test_pacing_like_a_limiter(spark):
    """Against limiters run one request after another."""
    from corpusloom.operators import pacing as PA

    rows = [(i, "ab"[i % 3 == 0], float((i * 13) % 17), i, float(1 + i % 4)) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, host string, at double, ord int, seconds double")
    order = sorted(rows, key=lambda r: (r[2], r[3]))
    starts = lambda df: {r["id"]: r["start"] for r in df.collect()}

    def limiter(key, interval):
        free, out = {}, {}
        for r in order:
            out[r[0]] = max(r[2], free.get(key(r), float("-inf")))
            free[key(r)] = out[r[0]] + interval
        return out

    assert starts(PA.paced(frame, 0.75)) == limiter(lambda r: 0, 0.75) and starts(PA.host_paced(frame, 1.5)) == limiter(lambda r: r[1], 1.5)
    busy, want = {}, {}
    for r in order:
        lane = (r[1], sum(1 for o in order[: order.index(r)] if o[1] == r[1]) % 2)
        want[r[0]] = max(r[2], busy.get(lane, 0.0))
        busy[lane] = want[r[0]] + r[4]
    assert starts(PA.at_once(frame, 2)) == want
    assert starts(PA.paced(frame, 0.0)) == {r[0]: r[2] for r in rows} and PA.paced(frame.limit(0), 1.0).collect() == []


def test_sitemaps_of_any_depth(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [(f"https://e.com/{name}", "text/xml", body.encode()) for name, body in [("sitemap.xml", f"<sitemapindex {ns}><sitemap><loc>/s1.xml</loc></sitemap><sitemap><loc>/sitemap.xml</loc></sitemap></sitemapindex>"), *[(f"s{i}.xml", f"<sitemapindex {ns}><sitemap><loc>/s{i + 1}.xml</loc></sitemap></sitemapindex>") for i in range(1, 6)], ("s6.xml", f"<urlset {ns}><url><loc>/deep</loc></url></urlset>")]]
    assert [r["url"] for r in DI.sitemap_urls(payloads(spark, *rows), "https://e.com").collect()] == ["https://e.com/deep"]
    assert DI.llms_full(payloads(spark, ("https://e.com/llms-full.txt", "text/plain", b"all")), "https://e.com/docs").first()["url"] == "https://e.com/llms-full.txt"


def test_ledger_replaced_in_order(spark, tmp_path):
    run = P.run(spark.createDataFrame([("https://e.com/b",), ("https://e.com/a",)], "url string"), responses(spark), cfg.RunConfig(), run_id="r")
    M.overwrite_sorted(run.manifest.drop("stage_ord"), str(tmp_path / "m"))
    assert [r["url"] for r in M.read(spark, str(tmp_path / "m")).collect()] == ["https://e.com/a", "https://e.com/b"]


def test_html_after_much_white_space(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions.content import is_probable_html

    rows = spark.createDataFrame([(" " * 395 + "\n" * 200 + "<!DOCTYPE html><html>",), (" " * 500 + "text",), ("\u2003\u00a0\x1c<HTML lang=x>",)], "body string")
    assert [r[0] for r in rows.select(is_probable_html(F.lit("text/plain"), F.col("body"))).collect()] == [True, False, True]
