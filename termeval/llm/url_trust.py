"""URL filters: rules for hosts and paths, and trust and distrust carried along links between hosts.

Where no rule fits a URL, its host decides. Trust starts at hosts whose pages
rules allow and follows links; distrust starts at hosts whose pages rules block
and follows links backwards, to hosts that link to them. Both are personalised
PageRanks over the edges between hosts, solved in steps of joins and sums.

Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise

DAMPING = 0.85
# Propagation goes on until no value changes by this. Each step's changes are less than
# the last one's by the damping, so it ends. A table is written, and the changes are
# looked at, after each round of steps.
TOLERANCE = 1e-9
STEPS_PER_ROUND = 8
# A host is blocked if it has at least half of what a wholly blocked host starts
# with, and more distrust than trust.
LEAST_DISTRUST = 0.5 * (1 - DAMPING)

# The pages of one host are dealt into so many parts when something of the host is joined to them.
PARTS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def host(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#``, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and ``rules``, those of its domain and all domains above it."""
    named = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block")).select(
        F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("domain"),
        F.struct(
            F.length("rule").alias("length"),
            "rule",
            "verdict",
            F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"),
        ).alias("found"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    domains = hosts.where("host != ''").select("host", F.explode(suffixes).alias("domain"))
    return domains.join(named, "domain").groupBy("host").agg(F.collect_set("found").alias("rules"))


def ruled(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``ruled``: the longest rule that fits, and its verdict.

    A rule is a domain and the start of a path, as ``example.org/fr/``; it fits
    the domain and all below it. Of equally long rules the greater text wins.
    Both columns are null where none fits.
    """
    parsed = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    known = _rules_of_hosts(parsed.select("host").distinct(), rules)
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return with_host(parsed, known, id_col).select(
        F.col(id_col), "host", "path", best["rule"].alias("rule"), best["verdict"].alias("ruled")
    )


def with_host(pages: DataFrame, hosts: DataFrame, id_col: str) -> DataFrame:
    """``pages`` left-joined to ``hosts`` (one row a host), the pages of a host in ``PARTS`` parts.

    A host's row is copied to the parts that have pages only, so a host of any
    share of all pages is spread, and others are copied as often as they have pages at most.
    """
    dealt = pages.withColumn("_part", F.pmod(F.xxhash64(id_col, "path"), F.lit(PARTS)))
    copies = dealt.select("host", "_part").distinct().join(hosts, "host")
    return dealt.join(copies, ["host", "_part"], "left").drop("_part")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src``, ``dst``, ``share``: of all links from a host to other hosts, the part that leads to ``dst``."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))
    edges = (
        pages.select(host(F.col(url_col)).alias("src"), F.explode(found).alias("dst"))
        .withColumn("dst", F.translate("dst", UPPER, LOWER))
        .where("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    return edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of every host in ``seeds`` or reached from one.

    ``seeds`` has ``host``, ``allowed``, ``blocked`` (0 to 1); ``edges`` as of ``links``.
    """
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("host"), "share")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("source"), F.col("src").alias("host"), "share")
    flows = materialise(forward.unionByName(backward), "host-flows")
    start = seeds.select(
        "host",
        F.explode(
            F.array(
                F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("value")),
                F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("value")),
            )
        ).alias("seed"),
    ).select("seed.kind", "host", ((1 - DAMPING) * F.col("seed.value")).alias("value"))
    start = materialise(start.where("value > 0"), "host-seeds")
    ranks = start
    if flows.isEmpty():
        return _wide(ranks)
    while True:
        for _ in range(STEPS_PER_ROUND):
            before = ranks
            moved = flows.join(ranks.withColumnRenamed("host", "source"), ["kind", "source"]).select(
                "kind", "host", (DAMPING * F.col("share") * F.col("value")).alias("value")
            )
            ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("value").alias("value"))
        # Both the last step's values and those before it, so that none is computed twice.
        both = ranks.withColumn("last", F.lit(True)).unionByName(before.withColumn("last", F.lit(False)))
        both = materialise(
            both.groupBy("kind", "host").agg(
                F.coalesce(F.sum(F.when(F.col("last"), F.col("value"))), F.lit(0.0)).alias("value"),
                F.coalesce(F.sum(F.when(~F.col("last"), F.col("value"))), F.lit(0.0)).alias("was"),
            ),
            "host-ranks",
        )
        ranks = both.select("kind", "host", "value")
        if (both.agg(F.max(F.abs(F.col("value") - F.col("was")))).first()[0] or 0.0) < TOLERANCE:
            return _wide(ranks)


def _wide(ranks: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)

    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` of every page.

    ``rules`` has ``rule`` and ``verdict`` (allow or block). A null URL, or one
    without ``://``, has an empty host and path and no rule, and is allowed, as is
    a page whose host neither trust nor distrust reaches. Null pages of HTML have
    no links. Repeated rows come out as often as they went in; other columns are
    left out. Without rules every page is allowed.
    """
    found = ruled(pages, rules, id_col, url_col)
    seeds = (
        found.where("host != ''")
        .groupBy("host")
        .agg(
            F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
            F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked"),
        )
    )
    ranks = propagate(seeds, links(pages, url_col, html_col))
    blocked = ranks.where((F.col("distrust") >= LEAST_DISTRUST) & (F.col("distrust") > F.col("trust"))).select(
        "host", F.lit("block").alias("by_host")
    )
    return with_host(found, blocked, id_col).select(
        id_col, "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict")
    )
