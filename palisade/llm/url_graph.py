"""URL filters: prefix rules first, then trust and distrust over the graph of links between hosts.

Trust is a personalised PageRank that starts at trusted seed hosts and follows links; distrust starts at blocked seed
hosts and follows links backwards, so that it reaches hosts that link to blocked ones. A host whose distrust exceeds
its trust by the threshold is blocked. Seeds are the hosts whose own pages the rules mostly allow or mostly block. Every
seed starts with 1, so that what one seed gives doesn't depend on how many others there are on either side.
"""

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def best_rule(rules, host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, weight: how many links from pages of one host name another host. Relative links stay on their host."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), 1)
    return (pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("link"))
            .select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
            .filter("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def rank(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, most_rounds: int, name: str) -> DataFrame:
    """Personalised PageRank (host, score): seeds (host, weight) start with their weight, and each round a share `damping` of
    what a host was last given moves on along its links, by their weight. A score is all that a host was ever given.

    Scaled to a sum of 1 these are the scores of the walk that returns to the seeds where it stops or finds no link. Rounds
    end when what still moves is at most tolerance x the seeds' weight and the last round reached no new host; a warning
    says if most_rounds ended them first. A round writes one table of the hosts reached; the driver holds two numbers.
    """
    out_sum = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    steps = cut(edges.join(out_sum, "src").select("src", "dst", (F.col("weight") / F.col("out") * damping).alias("share")), f"{name}-steps")
    scores = seeds.select("host", F.col("weight").alias("score"), F.col("weight").alias("last"))
    start = seeds.agg(F.sum("weight").alias("last"), F.count(F.lit(1)).alias("n")).first()
    if not start["n"] or steps.isEmpty():
        return scores.select("host", "score")
    before = start["n"]
    for _ in range(most_rounds):
        given = (steps.join(scores.filter("last > 0").select(F.col("host").alias("src"), "last"), "src")
                 .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("last")).alias("last")))
        both = scores.select("host", "score", F.lit(0.0).alias("last")).unionByName(given.select("host", F.col("last").alias("score"), "last"))
        scores = cut(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("last").alias("last")), f"{name}-scores")
        now = scores.agg(F.sum("last").alias("last"), F.count(F.lit(1)).alias("n")).first()
        if now["last"] <= tolerance * start["last"] and now["n"] == before:
            break
        before = now["n"]
    else:
        warnings.warn(f"{name}: {most_rounds} rounds ended with {now['last'] / start['last']:.2g} of the seeds' weight still moving", stacklevel=2)
    return scores.select("host", "score")


def host_scores(pages: DataFrame, rules=DEFAULT_RULES, url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-3, most_rounds: int = 200, extra_trusted=(), extra_blocked=()) -> DataFrame:
    """host, trust, distrust for every host that a seed's score reaches."""
    judged = (pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
              .filter("host <> ''").withColumn("said", best_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict)))
    hosts = cut(judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad")), "hosts")
    named = lambda names: F.col("host").isin(list(names)) if names else F.lit(False)
    trusted = hosts.filter((F.col("good") * 2 > F.col("n")) | named(extra_trusted))
    blocked = hosts.filter((F.col("bad") * 2 > F.col("n")) | named(extra_blocked))
    edges = cut(link_edges(pages, url_col, html_col), "links")
    scores = []
    for name, seeds, graph in (("trust", trusted, edges), ("distrust", blocked, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))):
        scores.append(rank(graph, seeds.select("host", F.lit(1.0).alias("weight")), damping, tolerance, most_rounds, name).withColumnRenamed("score", name))
    return (scores[0].join(scores[1], "host", "full_outer")
            .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))


def judge_urls(pages: DataFrame, rules=DEFAULT_RULES, url_col: str = "url", html_col: str = "html", threshold: float = 0.0, broadcast_hosts: int = 200_000, **graph) -> DataFrame:
    """pages with host, path, rule, verdict, trust, distrust.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule decides. Without a
    rule, a host is blocked if distrust - trust > threshold, else allowed; a host that no seed's score reaches is allowed.
    A null url, or one without "://", has an empty host and path, fits no rule and is allowed. Repeated pages are judged
    alike; a null html has no links. Columns of pages with the result's names are replaced; other columns pass.
    The host table is broadcast only up to broadcast_hosts rows; beyond, it is joined by shuffle.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    scores = cut(host_scores(pages, rules, url_col, html_col, **graph), "host-scores")
    scores = scores.withColumnRenamed("host", "_host")
    if scores.count() <= broadcast_hosts:
        scores = F.broadcast(scores)
    pages = pages.drop(*({"host", "path", "rule", "verdict", "trust", "distrust"} - {url_col, html_col}))
    named = pages.withColumns({"host": host, "path": path})
    named = named.withColumn("rule", best_rule(rules, F.col("host"), F.col("path"), lambda r: r.name))
    said = best_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    by_graph = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > threshold, "block").otherwise("allow")
    return (named.join(scores, F.col("host") == F.col("_host"), "left").drop("_host")
            .withColumn("verdict", F.coalesce(said, by_graph)))
