"""Discovery sources over captured payloads: llms.txt, sitemaps, search indexes; the first that yields a URL wins.

Payloads are a table responses(url, status, content_type, body BINARY); the engine never opens a network connection here."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content as C
from ..functions import urls as U
from ..operators.urls import same_origin_as
from ..shared import new_folder, written

# Targets of inline Markdown links, and URLs that stand by themselves in what is left of a line. The characters that end a URL.
TARGET = r"\]\((https?://[^\s)]+)\)"
BARE = r"https?://[^\s)\]]+"
# Where sitemaps and search indexes are looked for, in this order.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml.gz", "/sitemap_index.xml.gz", "/sitemap-index.xml.gz", "/sitemap.gz"]
SEARCH_PATHS = ["search/search_index.json", "search_index.json", "search-index.json", "search.json", "index.json", "assets/search.json", "search/search-index.json"]
SEARCH_KEYS = ["docs", "documents", "entries", "pages", "index"]


def bodies(responses: DataFrame, most_bytes: int = 0) -> DataFrame:
    """url and body of responses with status 200 that aren't too large."""
    good = (F.col("status") == 200) & (F.lit(True) if most_bytes <= 0 else F.octet_length("body") <= most_bytes)
    return responses.where(good)


def first_candidate(found: DataFrame) -> DataFrame:
    """url rows of the candidate with the least rank. found: rank, url."""
    return found.join(F.broadcast(found.agg(F.min("rank").alias("best"))), F.col("rank") == F.col("best")).drop("best")


def llms_links(texts: DataFrame) -> DataFrame:
    """texts: body and further columns. Of each its further columns, pos and url (canonical): a line that starts with a URL is one as a whole; then the targets
    of a line's Markdown links, then the URLs that stand outside them."""
    kept = [c for c in texts.columns if c != "body"]
    lines = texts.select(*kept, F.posexplode(F.split(F.col("body").cast("string"), C.LINE_ENDS)).alias("line_no", "line"))
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    whole = F.when(line.rlike("^https?://"), F.array(line)).otherwise(F.array().cast("array<string>"))
    found = F.concat(whole, F.regexp_extract_all(line, F.lit(TARGET), 1), F.regexp_extract_all(F.regexp_replace(line, TARGET, " "), F.lit(BARE), 0))
    each = lines.select(*kept, "line_no", F.posexplode(found).alias("at", "raw"))
    return each.select(*kept, F.struct("line_no", "at").alias("pos"), U.normalize_url(F.col("raw")).alias("url"))


def llms_urls(responses: DataFrame, base_url: str, most_bytes: int = 0) -> DataFrame:
    """url, pos: same-origin URLs of the most specific llms.txt that has any, each where it stands first."""
    names = [f"{b}/llms.txt" for b in U.candidate_bases(base_url)]
    ranks = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    urls = llms_links(bodies(responses, most_bytes).where(F.col("url").isin(names)).select(ranks[F.col("url")].alias("rank"), "body"))
    return first_candidate(same_origin_as(urls.groupBy("rank", "url").agg(F.min("pos").alias("pos")), base_url)).drop("rank")


def llms_full(responses: DataFrame, base_url: str) -> DataFrame:
    """url of the first llms-full.txt with a body."""
    names = [f"{b}/llms-full.txt" for b in U.candidate_bases(base_url)]
    ranks = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return bodies(responses).where(F.col("url").isin(names) & (F.trim(F.col("body").cast("string")) != "")).orderBy(ranks[F.col("url")]).select("url").limit(1)


def inflated(body: bytes, url: str, content_type: str | None) -> bytes:
    """Gunzipped where the name or type says so; as it is where that fails."""
    if url.endswith(".gz") or "gzip" in (content_type or "").lower():
        try:
            return gzip.decompress(body)
        except (OSError, EOFError):
            pass
    return body


def parse_sitemap(body: bytes) -> tuple[str, list[str]]:
    """('index', 'urlset' or 'unknown', locations). Names match whatever their case and namespace; only the loc of a sitemap or url of its own counts."""
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return "unknown", []
    name = lambda e: str(e.tag).rpartition("}")[2].lower()
    kind, entries = {"sitemapindex": ("index", "sitemap"), "urlset": ("urlset", "url")}.get(name(root), ("unknown", ""))
    return kind, [loc.text.strip() for entry in root if name(entry) == entries for loc in entry if name(loc) == "loc" and loc.text and loc.text.strip()]


def sitemap_locs(payloads: DataFrame, most_bytes: int = 0) -> DataFrame:
    """payloads: url, content_type, body and further columns. Further columns, kind and loc (absolute) of every location; too large ones, once inflated, have none."""
    fields = [f for f in payloads.schema.fields if f.name not in ("url", "content_type", "body")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for url, content_type, body, *kept in zip(rows["url"], rows["content_type"], rows["body"], *(rows[f.name] for f in fields), strict=True):
                whole = inflated(bytes(body or b""), url, content_type)
                kind, found = parse_sitemap(whole) if most_bytes <= 0 or len(whole) <= most_bytes else ("unknown", [])
                out += [(*kept, kind, loc if loc.startswith(("http://", "https://")) else urljoin(url, loc)) for loc in found]
            yield pd.DataFrame(out, columns=[*(f.name for f in fields), "kind", "loc"])

    schema = T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("loc", T.StringType())])
    return payloads.select("url", "content_type", "body", *[f.name for f in fields]).mapInPandas(parse, schema)


def sitemap_seeds(responses: DataFrame, base_url: str) -> list[str]:
    """Sitemap lines of robots.txt, which replace the usual places."""
    origin = U.candidate_bases(base_url)[-1]
    lines = (robots_text(responses, base_url) or "").splitlines()
    return [line[8:].strip() for line in lines if line[:8].lower() == "sitemap:"] or [origin + p for p in SITEMAP_PATHS]


def sitemap_urls(responses: DataFrame, base_url: str, most_bytes: int = 0) -> DataFrame:
    """url: same-origin URLs of all sitemaps reached, however deep. Each level is a join of the sitemaps to read with the payloads; an anti join stops cycles."""
    spark = responses.sparkSession
    payloads = bodies(responses, most_bytes).select("url", "content_type", "body")
    todo = spark.createDataFrame([(u,) for u in sitemap_seeds(responses, base_url)], "url string").distinct()
    seen = written(todo, new_folder(spark, "sitemaps"))
    todo, urls = seen, None
    while True:
        parsed = written(sitemap_locs(payloads.join(todo, "url", "left_semi"), most_bytes), new_folder(spark, "locations"))
        found = parsed.where("kind = 'urlset'").select(F.col("loc").alias("url"))
        urls = found if urls is None else urls.unionByName(found)
        todo = written(parsed.where("kind = 'index'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"), new_folder(spark, "sitemaps"))
        if todo.isEmpty():
            break
        seen = seen.unionByName(todo)
    return same_origin_as(urls.select(U.normalize_url(F.col("url")).alias("url")).distinct(), base_url).orderBy("url")


def json_urls(data: object, base: str) -> list[str]:
    """URLs of a search index: of each object in a list its url, path and location; an object is searched under the usual keys, then itself."""
    own = lambda d: [urljoin(base, d[k]) for k in ("url", "path", "location") if isinstance(d.get(k), str)]
    if isinstance(data, list):
        return [u for d in data if isinstance(d, dict) for u in own(d)]
    if isinstance(data, dict):
        return [u for k in SEARCH_KEYS if k in data for u in json_urls(data[k], base)] + own(data)
    return []


def search_links(payloads: DataFrame, base_url: str | None = None) -> DataFrame:
    """payloads: url, body and further columns. Further columns and url of every entry of a search index, against base_url, or else the payload's own URL; what isn't JSON has none."""
    fields = [f for f in payloads.schema.fields if f.name not in ("url", "body")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for url, body, *kept in zip(rows["url"], rows["body"], *(rows[f.name] for f in fields), strict=True):
                try:
                    out += [(*kept, u) for u in json_urls(json.loads(bytes(body or b"")), base_url or url)]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=[*(f.name for f in fields), "url"])

    return payloads.select("url", "body", *[f.name for f in fields]).mapInPandas(walk, T.StructType([*fields, T.StructField("url", T.StringType())]))


def search_index_urls(responses: DataFrame, base_url: str, most_bytes: int = 0) -> DataFrame:
    names = [f"{b}/{p}" for b in U.candidate_bases(base_url) for p in SEARCH_PATHS]
    ranks = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    found = search_links(bodies(responses, most_bytes).where(F.col("url").isin(names)).select("url", "body", ranks[F.col("url")].alias("rank")), base_url)
    canonical = found.select("rank", U.normalize_url(F.col("url")).alias("url")).distinct()
    return first_candidate(same_origin_as(canonical, base_url)).select("url").orderBy("url")


def robots_text(responses: DataFrame, base_url: str) -> str | None:
    """The captured robots.txt of the base's origin."""
    found = bodies(responses).where(F.col("url") == f"{U.candidate_bases(base_url)[-1]}/robots.txt").select("body").first()
    return found["body"].decode("utf-8", "ignore") if found else None


def discover(responses: DataFrame, base_url: str, crawl=None, most_bytes: int = 0) -> tuple[str, DataFrame] | None:
    """(source, urls) of the first source with any URL: llms.txt, sitemap, search index, then the crawl given."""
    for source, find in (("llms_txt", llms_urls), ("sitemap", sitemap_urls), ("search_index", search_index_urls)):
        urls = find(responses, base_url, most_bytes).select("url")
        if not urls.isEmpty():
            return source, urls
    if crawl is not None:
        return "bfs", crawl()
    return None
