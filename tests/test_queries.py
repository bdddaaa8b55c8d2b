import pytest
from pyspark.sql import functions as F

from corpusloom import queries as q

from .oracle import same


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_against_sql(spark, sf_dir, name):
    same(spark, sf_dir, q.QUERIES[name], q.SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert {r["dimension"] for r in entry.entry(spark).collect()} >= {"status", "note"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_truncation_keeps_the_budget(spark, sf_dir):
    for r in q.truncate_content(spark, sf_dir).collect():
        assert r["bytes"] <= 500 and "�" not in r["text"]


def test_quota_is_an_ordered_fold(spark, sf_dir):
    sizes = sorted((r["page_id"], len(r["html"].encode())) for r in q.pages(spark, sf_dir).collect())
    used, want = 0, []
    for i, n in sizes:
        if len(want) < 50 and used + n <= 60_000:
            want.append(i)
            used += n
    assert sorted(r["ord"] for r in q.snapshot_quota(spark, sf_dir).collect()) == want


def test_whole_runs_have_no_page_limit(spark):
    """sf0.01 has more than 100 unique URLs; each is fetched or refused by robots."""
    rows = q.QUERIES["manifest_rows_whole"](spark, "/root/testdata/sf0.01").toPandas()
    limited = q.manifest_rows(spark, "/root/testdata/sf0.01").toPandas()
    assert not (rows["note"] == "max_pages_limit").any()
    assert (limited["note"] == "max_pages_limit").any() and len(rows) == len(limited)
    assert (rows["status"] == "ok").sum() > 100 >= (limited["status"] == "ok").sum()
    assert not any("LIMIT 100)," in q.SQL[n].split("unique_ AS")[1] for n in q.SQL if n.endswith("_whole"))


def test_titles_with_unended_references(spark, tmp_path):
    """Titles that were cut within a reference (eight of sf0.1's are) are those of the SQL; the parser itself reads them as HTML does."""
    from corpusloom.functions.html import h1_of, parse, title_of

    titles = ["a&amp;&amp", "a&amp;&amp;amp", "&copy &copy;", "x &quot", "&amp;quot;", "R&D &", "&#38 b&middot"]
    pages = [(i, f"https://x.example/{i}", f'<html><head><title>{t} </title></head><body><a href="/a?b&copy=1">l</a><h1> {t}</h1></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    for rest in (tmp_path / "made").iterdir():
        rest.unlink()
    (tmp_path / "made").rmdir()
    same(spark, str(tmp_path), q.title_h1, q.SQL["title_h1"])
    root = parse(pages[0][2])
    assert (title_of(root), h1_of(root)) == ("a&&", "a&&")


def test_next_level_is_of_all_pages(spark, sf_dir):
    got = {r["dst"] for r in q.QUERIES["bfs_next_level"](spark, sf_dir).collect()}
    one = {r["dst"] for r in q.bfs_frontier(spark, sf_dir).collect()}
    known = {r["url"] for r in q.canonical(spark, sf_dir).collect()}
    plain = {r["dst"] for r in q.links(spark, sf_dir).collect() if "?" not in r["dst"]}
    print(len(one), len(got), len(plain))
    assert one <= got and len(got) > len(one) and not got & known
    assert plain - known <= got


@pytest.mark.parametrize("name", ["failures_table_whole", "index_view_whole", "ok_urls_whole", "title_h1", "links", "named_functions"])
def test_pages_are_parsed_once_in_small_batches(spark, sf_dir, name):
    """One evaluation, though filters on its results follow, and none by Arrow: its batches are 10,000 rows, however long the pages are."""
    plan = q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan


def test_a_worker_holds_few_pages(spark, monkeypatch):
    """Its memory, told in place of each page's Markdown: 3,000 pages of 200 kB, 600 MB of them in one task, must not be held at once."""
    from corpusloom.functions import html

    def held(root, extractor):
        pages = int(open("/proc/self/statm").read().split()[1])
        return str(pages * 4096 // 1_000_000), extractor

    monkeypatch.setattr(html, "convert", held)
    made = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("<p>"), "id", F.repeat(F.lit("x"), 200_000)).alias("html"))
    mb = made.select(html.page_parts(F.col("html"))["markdown"].cast("int").alias("mb")).agg(F.count("mb"), F.max("mb")).first()
    print(mb)
    assert mb[0] == 3000 and mb[1] < 200


def test_the_ledger_of_a_run_parses_pages_once(spark, sf_dir):
    from corpusloom.schema import valid_row

    plan = q.manifest(spark, sf_dir, q.WHOLE).where(valid_row())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_links_are_resolved_once(spark, sf_dir):
    """Each step's value is computed once: a plan that puts resolve() in wherever the canonical form names its URL has over a thousand of these."""
    from corpusloom.plans import crawl as CR

    plan = CR.edges(q.pages(spark, sf_dir).select("url", "html"), q.CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("regexp_extract") < 150


def test_levels_of_a_crawl_read_links_in_scope_alone(spark, tmp_path):
    from corpusloom.config import RunConfig
    from corpusloom.plans import crawl as CR

    html = '<html><a href="/docs/b">b</a><a href="/other">o</a><a href="https://y.example/docs/c">c</a></html>'
    made = spark.createDataFrame([(f"https://x.example/docs/{k}", 200, "text/html", html) for k in "ab"], "url string, status int, content_type string, html string")
    for given in (None, CR.edges(made.select("url", "html"), RunConfig())):
        folder = f"{tmp_path}/{given is None}"
        got = CR.crawl(made, RunConfig(base_url="https://x.example/docs/a", max_pages=0), folder, links=given)
        assert {r["url"] for r in got.collect()} == {"https://x.example/docs/a", "https://x.example/docs/b"}
        assert {r["dst"] for r in spark.read.parquet(f"{folder}/*/edges").collect()} == {"https://x.example/docs/b"}
