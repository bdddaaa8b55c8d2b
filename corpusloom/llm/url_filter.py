"""URL filters: rules, then empirical-Bayes host reputation (operator 9).

A rule (host, path) fits its host and all below it where the path starts with the rule's; the longest wins. Pages without a rule
are judged by their site (the host without user and port): page outcomes, read from the content alone, are counted per site, registered
domain and suffix; each level's rate is shrunk through a beta-binomial prior towards the level above, counted there without the
level's own pages. The prior's strength is estimated for each level by moments. A site is blocked if its posterior, a beta
distribution, puts at least SURE of its mass above the tolerated share of bad pages.

Defined results: a null url, or one without ://, has empty host and path and is allowed; null html has no bad marks; repeated
rows count as often as they occur and get the same verdict; of rules of one length the one that stands later goes first; whole
urls and pages are read, however long; an empty table gives no rows; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_not, written

#: Rules as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Marks of a bad page in its markup: repeated exclamation and question marks, runs of symbols.
BAD_TEXT = r"[!?]{2}|[%#*=]{3}|(&amp;){3}"
#: Suffixes of two labels under which domains are registered; all others are the last label.
SUFFIXES = ["ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "github.io", "gov.uk", "net.au", "or.jp", "org.au", "org.uk"]
TOLERATED, SURE = 0.2, 0.95


def with_host(pages: DataFrame) -> DataFrame:
    """pages with host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, whole, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, whole, 2)})


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, which are longer, go first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def with_site(rows: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """rows with site (host without user and port), domain and suffix. An address of numbers is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    rows = rows.withColumn("site", bare)
    labels = F.split("site", r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    number, double = F.col("site").rlike(r"^([0-9.]+|\[.*)$"), last(2).isin(suffixes)
    domain = F.when(number, F.col("site")).when(double, last(3)).otherwise(last(2))
    return rows.withColumns({"domain": domain, "suffix": F.when(number, F.col("site")).when(double, last(2)).otherwise(last(1))})


def beta_below(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Mass of beta distributions at or below x (the regularised incomplete beta function), by its continued fraction."""
    a, b = (np.asarray(v, np.float64) for v in (a, b))
    swap = x > (a + 1) / (a + b + 2)  # there the fraction of the mirrored distribution converges fast
    p, q, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log_gamma = lambda v: np.array([math.lgamma(u) for u in v.ravel()]).reshape(v.shape)
    front = np.exp(p * np.log(x) + q * np.log1p(-x) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    away = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(p), 1 / away(1 - (p + q) * x / (p + 1))
    total = d.copy()
    for m in range(1, 10_000):
        done = True
        for step in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / away(1 + step * d), away(1 + step / c)
            total = total * d * c
            done = done and bool((np.abs(d * c - 1) < 1e-12).all())
        if done:
            break
    return np.clip(np.where(swap, 1 - front * total, front * total), 0, 1)


def _above(level: DataFrame, *keys: str) -> DataFrame:
    """The level above: n, b and, of what is below, the number, the sum of squared n, and the sum of b squared over n."""
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("below"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("b2")]
    return (level.groupBy(*keys).agg(*sums) if keys else level.agg(*sums)).where("n is not null")


def _strength(level: DataFrame) -> float:
    """Strength of the beta prior of what is below a level, by moments: the variance that sampling doesn't explain is rate (1 - rate) / (strength + 1)."""
    rate = (F.col("b") + 0.5) / (F.col("n") + 1)
    weight, noise = F.col("n") - F.col("n2") / F.col("n"), rate * (1 - rate)
    found = level.agg(F.sum(weight).alias("w"), F.sum(weight * noise).alias("m"), F.sum(F.col("b2") - F.col("b") * F.col("b") / F.col("n") - (F.col("below") - 1) * noise).alias("v")).first()
    return min(max(found["m"] / max(found["v"], 1e-6 * found["w"]) - 1, 1.0), 100.0) if found["w"] and found["w"] > 1e-9 else 1.0


def reputations(outcomes: DataFrame, tolerated: float = TOLERATED, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """outcomes: host, bad (0 or 1), one row per labelled page. site, n, b (bad pages), rate (posterior mean), above (posterior mass above tolerated)."""
    sites = with_site(outcomes, suffixes).groupBy("site", "domain", "suffix").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    sites = written(sites, "sites")
    domains = written(_above(sites, "domain", "suffix"), "domains")
    tops = written(_above(domains, "suffix"), "suffixes")
    whole = _above(tops)
    of = [_strength(level) for level in (whole, tops, domains)]  # of suffixes, domains and sites
    total = whole.select("n", "b").first()
    all_n, all_b = total or (0.0, 0.0)
    named = lambda level, letter: level.select(*[c for c in ("domain", "suffix") if c in level.columns], F.col("n").alias(f"{letter}n"), F.col("b").alias(f"{letter}b"))
    joined = sites.join(small_or_not(named(domains, "d"), domains.count(), 120), ["domain", "suffix"]).join(small_or_not(named(tops, "s"), tops.count(), 60), "suffix")
    # Each level without the pages of the one below it.
    of_all = (F.lit(all_b) - F.col("sb") + of[0] * (all_b + 0.5) / (all_n + 1)) / (F.lit(all_n) - F.col("sn") + of[0])
    of_suffix = (F.col("sb") - F.col("db") + of[1] * of_all) / (F.col("sn") - F.col("dn") + of[1])
    of_domain = (F.col("db") - F.col("b") + of[2] * of_suffix) / (F.col("dn") - F.col("n") + of[2])
    k = of[2]

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            a, z = (rows["b"] + k * rows["prior"]).to_numpy(), (rows["n"] - rows["b"] + k * (1 - rows["prior"])).to_numpy()
            yield rows[["site", "n", "b"]].assign(rate=a / (a + z), above=1 - beta_below(a, z, tolerated))

    return joined.select("site", "n", "b", of_domain.alias("prior")).mapInPandas(bound, "site string, n double, b double, rate double, above double")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, tolerated: float = TOLERATED, sure: float = SURE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = with_host(pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")))
    bad = F.col("html").rlike(BAD_TEXT).cast("int")
    known = reputations(rows.where("host <> ''").select("host", bad.alias("bad")), tolerated)
    blocked = written(known.where(F.col("above") >= sure).select(F.col("site").alias("blocked")), "blocked")
    blocked = small_or_not(blocked, blocked.count(), 100)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = with_site(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")))
    return ruled.join(blocked, ruled.site == blocked.blocked, "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# The mass of the beta distribution is summed over 4,000 angles, the rate being the square of their sine, on the side of the bound where it is smooth.
OP9_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
w AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM p),
l AS (SELECT *, string_split(site, '.') AS parts, regexp_matches(site, '^([0-9.]+|\[.*)$') AS number, array_to_string(list_slice(string_split(site, '.'), -2, -1), '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) AS double_ FROM w),
h AS (SELECT site, CASE WHEN number THEN site WHEN double_ THEN array_to_string(list_slice(parts, -3, -1), '.') ELSE array_to_string(list_slice(parts, -2, -1), '.') END AS domain,
             CASE WHEN number THEN site WHEN double_ THEN array_to_string(list_slice(parts, -2, -1), '.') ELSE parts[-1] END AS suffix,
             count(*)::DOUBLE AS n, sum(CASE WHEN regexp_matches(html, '{BAD_TEXT}') THEN 1.0::DOUBLE ELSE 0.0 END) AS b FROM l WHERE host <> '' GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b, count(*) AS below, sum(n * n) AS n2, sum(b * b / n) AS b2 FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(b) AS b, count(*) AS below, sum(n * n) AS n2, sum(b * b / n) AS b2 FROM d GROUP BY suffix),
t AS (SELECT sum(n) AS n, sum(b) AS b, count(*) AS below, sum(n * n) AS n2, sum(b * b / n) AS b2 FROM s),
k0 AS (SELECT CASE WHEN w > 1e-9 THEN least(greatest(m / greatest(v, 1e-6 * w) - 1, 1.0), 100.0) ELSE 1.0 END AS k0 FROM (SELECT sum(n - n2 / n) AS w, sum((n - n2 / n) * (b + 0.5) / (n + 1) * (1 - (b + 0.5) / (n + 1))) AS m,
       sum(b2 - b * b / n - (below - 1) * (b + 0.5) / (n + 1) * (1 - (b + 0.5) / (n + 1))) AS v FROM t)),
k1 AS (SELECT CASE WHEN w > 1e-9 THEN least(greatest(m / greatest(v, 1e-6 * w) - 1, 1.0), 100.0) ELSE 1.0 END AS k1 FROM (SELECT sum(n - n2 / n) AS w, sum((n - n2 / n) * (b + 0.5) / (n + 1) * (1 - (b + 0.5) / (n + 1))) AS m,
       sum(b2 - b * b / n - (below - 1) * (b + 0.5) / (n + 1) * (1 - (b + 0.5) / (n + 1))) AS v FROM s)),
k2 AS (SELECT CASE WHEN w > 1e-9 THEN least(greatest(m / greatest(v, 1e-6 * w) - 1, 1.0), 100.0) ELSE 1.0 END AS k2 FROM (SELECT sum(n - n2 / n) AS w, sum((n - n2 / n) * (b + 0.5) / (n + 1) * (1 - (b + 0.5) / (n + 1))) AS m,
       sum(b2 - b * b / n - (below - 1) * (b + 0.5) / (n + 1) * (1 - (b + 0.5) / (n + 1))) AS v FROM d)),
prior AS (SELECT site, h.n, h.b, k2 AS k, (d.b - h.b + k2 * (s.b - d.b + k1 * (t.b - s.b + k0 * (t.b + 0.5) / (t.n + 1)) / (t.n - s.n + k0)) / (s.n - d.n + k1)) / (d.n - h.n + k2) AS mu
          FROM h JOIN d USING (domain, suffix) JOIN s USING (suffix), t, k0, k1, k2),
post AS (SELECT site, b + k * mu AS a, n - b + k * (1 - mu) AS z FROM prior),
f AS (SELECT site, a, z, sin(x) ** 2 > {TOLERATED} AS above, exp((2 * a - 1) * ln(sin(x)) + (2 * z - 1) * ln(cos(x)) + lgamma(a + z) - lgamma(a) - lgamma(z)) * pi() / 4000 AS mass
      FROM post, (SELECT (i + 0.5) * pi() / 8000 AS x FROM range(4000) r(i))),
bad AS (SELECT site FROM f GROUP BY site, a, z HAVING CASE WHEN a < z THEN sum(CASE WHEN above THEN mass ELSE 0 END) ELSE 1 - sum(CASE WHEN above THEN 0 ELSE mass END) END >= {SURE}),
r AS (SELECT page_id, host, path, site,
        CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM w)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN site IN (SELECT site FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
