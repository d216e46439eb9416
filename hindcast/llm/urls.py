"""URL filter: explicit rules first, and for all other pages the standing of their host in the link graph.

A rule (host, path, verdict) fits a url if the url's host is the rule's or a subdomain of it and the
url's path starts with the rule's; the longest fitting rule decides (ties: the first by host and path).

Hosts: pages that rules allow or block are votes of their host.  The surplus of allowed
votes makes a host a trusted seed, a surplus of blocked ones a blocked seed.  Trust
follows links (personalised PageRank from the trusted seeds), distrust runs against them
from the blocked seeds: who links to blocked hosts is distrusted.  Both are the sum over walks,
``x = seed + DAMPING * (shares of the neighbours)``, over ``ROUNDS`` rounds, so that a seed without links keeps the
weight of its votes; what comes after the last round is below DAMPING ** ROUNDS of the seeds.
A host whose distrust exceeds its trust by ``LEAST`` of its pages or more is blocked.

Weights are whole numbers (``UNIT`` a page) and a share is rounded down before it is added: results do not depend
on the order of additions, and SQL gives the same ones.  Host edges are counted before anything is joined;
both walks of a round are one join and one sum, and each round is written to the shared folder.
Rules are a short list, a parameter; blocklists of any length belong to the seeds (``votes``).

Defined cases: a null url or one without ``://`` has empty host and path and fits no rule; pages without a
host, links to the own host and null html make no edges; a repeated page counts as often as it stands.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.scratch import kept

#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UNIT, DAMPING, ROUNDS, LEAST = 1 << 20, 0.85, 16, 0.5
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?\s*((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column, mark: str = "://") -> Column:
    """Lower-case host after the first mark; empty without one."""
    name = F.regexp_extract(url, f"^(?s:.*?){mark}([^/?#]*)", 1)
    return F.coalesce(F.translate(name, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark or number sign."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits columns host and path, or null."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = None
    for name, start, verdict in order:
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def placed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))


def edges(pages: DataFrame) -> DataFrame:
    """Counted links between different hosts: src, dst, n."""
    links = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    links = links.select("src", host(F.col("link"), "//").alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def walks(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """kind, host and weight (long) after all rounds; ``seeds`` has kind ('trust' or 'distrust'), host and seed."""
    ways = links.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "n")
    ways = ways.unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "n"))
    out = ways.groupBy("kind", "at").agg(F.sum("n").alias("all"))
    ways = kept(ways.join(out, ["kind", "at"]).withColumn("share", damping * F.col("n") / F.col("all")).select("kind", "at", "to", "share"), "ways")
    seeds = kept(seeds, "seeds")
    now = seeds.withColumnRenamed("seed", "weight")
    if ways.isEmpty():
        return now
    for _ in range(rounds):
        moved = ways.join(now.withColumnRenamed("host", "at"), ["kind", "at"])
        moved = moved.select("kind", F.col("to").alias("host"), F.floor(F.col("weight") * F.col("share")).alias("weight"))
        added = moved.where("weight > 0").unionByName(seeds.select("kind", "host", F.col("seed").alias("weight")))
        now = kept(added.groupBy("kind", "host").agg(F.sum("weight").alias("weight")), "walks")
    return now


def standing(pages: DataFrame, votes: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """host, pages, trust, distrust and blocked of every host; ``votes`` has host, pages, allowed and blocked (counts)."""
    surplus = (F.col("allowed") - F.col("blocked")) * F.lit(UNIT)
    seeds = votes.where("host <> '' and allowed <> blocked").select(F.when(surplus > 0, "trust").otherwise("distrust").alias("kind"), "host", F.abs(surplus).alias("seed"))
    found = walks(edges(pages), seeds, damping, rounds)
    found = found.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0)).alias(k) for k in ("trust", "distrust")])
    out = votes.where("host <> ''").select("host", "pages").join(found, "host", "left")
    out = out.select("host", "pages", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("trust", "distrust")])
    return out.withColumn("blocked", F.col("distrust") - F.col("trust") >= least * UNIT * F.col("pages"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, **graph: float) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust (pages) of every page (columns page_id, url, html)."""
    slim = placed(pages.select("page_id", "url")).withColumn("fit", fitting(RULES if rules is None else rules))
    count = lambda verdict: F.count(F.when(F.col("fit.verdict") == verdict, 1))
    votes = kept(slim.groupBy("host").agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked")), "votes")
    hosts = standing(pages, votes, **graph).withColumnRenamed("host", "of")
    out = slim.join(hosts, F.col("host") == F.col("of"), "left")
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    units = [(F.coalesce(k, F.lit(0)) / F.lit(UNIT)).alias(k) for k in ("trust", "distrust")]
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), *units)
