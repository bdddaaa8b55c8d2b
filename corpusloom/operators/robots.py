"""Robots rules as a table, and their first-match filter."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def parse_robots(text: str) -> list[dict]:
    """Groups of a robots.txt: agents, rules (allow, path) in file order, and crawl delay."""
    groups, agents, rules, delay, in_rules = [], [], [], None, False

    def close() -> None:
        if agents and (rules or delay is not None):
            groups.append({"agents": agents, "rules": rules, "delay": delay})

    for line in text.splitlines():
        name, found, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not found:
            continue
        if name == "user-agent":
            if in_rules:
                close()
                agents, rules, delay, in_rules = [], [], None, False
            agents = [*agents, value.lower()]
        elif agents and name in ("allow", "disallow"):
            in_rules = True
            # An empty Disallow allows everything.
            rules = [*rules, (name == "allow" or not value, quote(unquote(value)))]
        elif agents and name == "crawl-delay":
            in_rules = True
            delay = float(value) if value.isdigit() else delay
    close()
    return groups


def group_for(groups: list[dict], user_agent: str) -> dict | None:
    """The first group that names the agent; else that of '*'. A named group replaces '*', it isn't added to it."""
    token = user_agent.split("/")[0].lower()
    named = next((g for g in groups if any(a != "*" and a in token for a in g["agents"])), None)
    return named or next((g for g in groups if "*" in g["agents"]), None)


def allowed(url: Column, rules: list[tuple[bool, str]]) -> Column:
    """First rule in file order whose path begins the URL's path and query decides; without one the URL is allowed."""
    query = U.part(url, U.QUERY)
    path = F.concat(F.when(U.part(url, U.PATH) == "", "/").otherwise(U.part(url, U.PATH)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    verdict = F.lit(True)
    for allow, prefix in reversed(rules):
        verdict = F.when(path.startswith(prefix), F.lit(allow)).otherwise(verdict)
    return verdict


def split_by_robots(urls: DataFrame, robots_txt: str | None, user_agent: str) -> tuple[DataFrame, DataFrame, float | None]:
    """(allowed URLs, disallowed URLs, crawl delay)."""
    group = group_for(parse_robots(robots_txt), user_agent) if robots_txt else None
    if not group:
        return urls, urls.limit(0), None
    ok = allowed(F.col("url"), group["rules"])
    return urls.where(ok), urls.where(~ok), group["delay"]


def disallowed_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, url) that a rules table (host, rule_ord, allow, prefix) disallows: an equi-join on host, the rules'
    prefixes compared within it, and the first match by min_by; a host's rules are few, its URLs may be many."""
    by_host = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "allow", "prefix"))).alias("rules"))
    joined = urls.join(by_host, "host")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])), F.lit(0))
    return joined.where(~F.coalesce(first["allow"], F.lit(True))).drop("rules")


def delayed_rate(rate: float, delay: float | None) -> float:
    """The lower of the configured rate and one request per crawl delay; 0 means unset."""
    by_delay = 1 / delay if delay else 0.0
    return by_delay if rate <= 0 else rate if by_delay <= 0 else min(rate, by_delay)
