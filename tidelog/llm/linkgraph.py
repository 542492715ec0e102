"""URL filters: rules, and trust and distrust spread over the host graph.

A rule decides every url that it fits.  The others are decided by their host:
hosts are seeds where rules allow or block most of their pages; trust spreads
along links (personalised PageRank from the trusted seeds), distrust against
them (from the blocked seeds to those who link there); a host is blocked where
its distrust reaches a limit and exceeds its trust.

Scores are in units of what a whole seed gives itself, whatever the number of
hosts and seeds; times (1 - damping) and divided by the sum of the seeds they
are the stationary distributions.  Rounds go on until what is still on its way
can't add a hundredth of the limit to any host.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import dom
from tidelog.llm.common import BROADCAST_BYTES, discard, join_side, pages, small_batches, stored

DAMPING = 0.85
#: A host is a seed where rules decide this share of its pages alike; the share is its seed's weight.
SEED_SHARE = 0.5
#: A host whose distrust is this or more, and more than its trust, is blocked.
LIMIT = 0.05
#: Scores are short of their limits by less than this.
SHORT = LIMIT / 100

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


@dataclass(frozen=True)
class Rule:
    """verdict for urls of a host, or of its subdomains, whose path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def link_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for sources in batches:
        yield pa.array([dom.links(x) for x in sources.to_pylist()], pa.list_(pa.string()))


def host_edges(table: DataFrame) -> DataFrame:
    """src, dst and links of the absolute links (href of a elements) between different hosts (page_id, url, html)."""
    small_batches(table.sparkSession)
    found = F.arrow_udf(link_batches, "array<string>")(F.coalesce("html", F.lit("")))
    links = table.select(host_of(F.col("url")).alias("src"), F.explode_outer(found).alias("link")).filter(F.col("link").rlike(ABSOLUTE))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    ends = links.select("src", host_of(full).alias("dst")).filter("src <> dst and src <> '' and dst <> ''")
    return ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, short: float = SHORT) -> DataFrame:
    """host, trust and distrust, for edges (src, dst, links) and seeds (host, trust, distrust).

    score = seed + damping * (shares that its neighbours hand over).  A round
    passes on what the round before has brought; scores are the sums over the
    rounds.  What all later rounds can bring is damping / (1 - damping) of the
    last one, which is the residual.  Both scores run in one table, distrust
    over the turned edges.  Hosts with neither seed nor score aren't returned.
    Every round is written; sums are combined before their shuffle, so neither a
    hub's many givers are gathered in a task; its many takers are rows of a join
    that broadcasts what was brought, or else is split where it is skewed.
    """
    spark = edges.sparkSession
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("taker"), "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("taker"), "links")
    )
    paths: list[str] = []
    given = stored(both.groupBy("kind", "giver").agg(F.sum("links").alias("all_links")), "host-links", paths)
    bytes_of = lambda c: F.octet_length("kind") + F.octet_length(c) + 8
    shares = join_side(both, given, ["kind", "giver"], bytes_of("giver")).select("kind", "giver", "taker", (damping * F.col("links") / F.col("all_links")).alias("share"))
    shares = stored(shares, "host-shares", paths)
    seed = seeds.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("host"), F.col(k).cast("double").alias("score")) for k in ("trust", "distrust")])).alias("s"))
    rounds: list[str] = []
    brought = stored(seed.select("s.*").filter("score > 0"), "host-brought", rounds)
    left = damping / (1 - damping)
    while True:
        known = brought.groupBy("kind").agg(F.sum("score").alias("mass"), F.sum(bytes_of("host") + F.lit(16)).alias("bytes")).collect()  # two rows
        if all(r["mass"] * left < short for r in known):
            break
        giver = brought.select(F.col("kind").alias("of"), "host", "score")
        side = F.broadcast(giver) if sum(r["bytes"] for r in known) <= BROADCAST_BYTES else giver
        handed = shares.join(side, (F.col("kind") == F.col("of")) & (F.col("giver") == F.col("host"))).select("kind", F.col("taker").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        brought = stored(handed.groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-brought", rounds)
    rank = spark.read.schema(brought.schema).parquet(*rounds)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
    out = stored(rank.groupBy("host").agg(of("trust"), of("distrust")), "host-scores")
    discard(spark, paths + rounds)
    return out


def judged(table: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page (page_id, url, html).

    A null url, or one without ://, has an empty host and path, fits no rule and
    is allowed.  A null html has no links.  Repeated rows come back as often; an
    empty table gives no rows; other columns aren't read.
    """
    named = table.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = named.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdict_of(F.col("rule"), rules))
    share = lambda v: F.count(F.when(F.col("by_rule") == v, 1)) / F.count(F.lit(1))
    weight = lambda v: F.when(share(v) >= SEED_SHARE, share(v)).otherwise(0.0)
    seeds = ruled.filter("host <> ''").groupBy("host").agg(weight("allow").alias("trust"), weight("block").alias("distrust"))
    edges = stored(host_edges(table), "host-edges")
    bad = scores(edges, seeds).filter((F.col("distrust") >= limit) & (F.col("distrust") > F.col("trust")))
    bad = stored(bad.select("host", F.lit(True).alias("bad")), "blocked-hosts")
    by_host = F.when(F.col("bad"), "block").otherwise("allow")
    met = join_side(ruled, bad, ["host"], F.octet_length("host"), "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"))


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(pages(spark, sf_dir).select("page_id", "url", "html"))
