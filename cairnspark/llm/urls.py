"""URL filters: rules on host and path first, then trust and distrust carried over the links between hosts.

Hosts are nodes; an edge goes from a host to each host that its pages link to, and from a host to its parent domain. Trust
starts at hosts whose pages the rules mostly allow and follows the edges; distrust starts at hosts whose pages the rules
mostly block and goes against them (who links to a blocked host is suspect). Both are personalised PageRanks in which every
seed restarts with a mass of its own, so what a host gets does not depend on how many other hosts there are. A step of either
is weighted by the linking host's own share of links: trust is what its links hand on, distrust is what its links lead to. So a
linker's distrust does not shrink with the number of others that link to the same blocked host.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import chained, drop_table, table


@dataclass(frozen=True)
class Rule:
    """verdict 'allow' or 'block' for a host, its subdomains, and paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def spelled(self) -> str:
        return self.host + self.path


#: Fixed rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Share of a rank that goes on over the edges.
DAMPING = 0.85

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for a url that is null or has no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; empty for a url that is null or has no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits (the first of equally long ones), as struct(rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.spelled)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.spelled).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links in html between hosts, counted, and one edge from each host to its parent domain."""
    linked = F.expr("""regexp_extract_all(html, '(?i)href\\\\s*=\\\\s*["\\']?([a-z][a-z0-9+.-]*:)?//([^/?#"\\'\\\\s>]+)', 2)""")
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(linked).alias("dst")).select(
        "src", F.translate("dst", _UPPER, _LOWER).alias("dst")
    )
    hosts = pages.select(host_of(F.col("url")).alias("src")).unionByName(links.select(F.col("dst").alias("src"))).distinct()
    parents = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1).alias("dst"))
    both = chained([links, parents]).where("src <> dst and src <> '' and dst <> ''")
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = 12) -> DataFrame:
    """(host, trust, distrust): personalised PageRanks from seeds (host, trust, distrust); edges (src, dst, n) carry trust
    forward and distrust backward, each by dst's share of all links of src. A seed restarts with its own mass, whatever the number
    of seeds. What a host without edges holds is not handed on. Ranks are tables every fourth round."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total") * damping).alias("share"))
    both = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "share") for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src"))))).alias("w")
    ways = table(shares.select(both).select("w.*"), "host-edges")
    start = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, rank)")).where("rank > 0")
    start = table(start.select("host", "kind", (F.col("rank") * (1 - damping)).alias("rank")), "seeds")
    ranks, kept = start, []
    for i in range(rounds):
        moved = ways.join(ranks.select(F.col("host").alias("src"), "kind", "rank"), ["kind", "src"]).select(
            F.col("dst").alias("host"), "kind", (F.col("rank") * F.col("share")).alias("rank")
        )
        ranks = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3:
            ranks = table(ranks, "ranks")
            kept.append(ranks)
    for old in kept[:-1]:
        drop_table(old)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, share: float = 0.1) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for pages (page_id, url, html).

    The longest rule that fits decides. Without one a page is blocked when its host's distrust is over its trust and at least that
    of a host which has `share` of its links to blocked hosts, and allowed otherwise; so are pages without a host. Both are
    shares of a host's own links, so neither the number of hosts nor that of links to a blocked one changes them. Null html
    and null urls have no links; html of any length is read whole, by one expression; repeated rows are judged one by one, and
    of equal ranks trust wins; other columns don't matter; an empty table gives no rows.
    """
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = placed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col("found.verdict")
    # a host is a seed by the verdict that most of its pages have
    shares = placed.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(verdict == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.avg(F.when(verdict == "block", 1.0).otherwise(0.0)).alias("blocked")
    )
    seeds = shares.select("host", (F.col("allowed") >= 0.5).cast("double").alias("trust"), (F.col("blocked") > 0.5).cast("double").alias("distrust"))
    ranks = propagate(host_edges(pages), seeds)
    by_rank = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= share * DAMPING * (1 - DAMPING)), "block").otherwise("allow")
    return placed.join(ranks, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(verdict, by_rank).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
