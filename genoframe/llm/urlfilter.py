"""URL filters: host and path rules, and link-graph propagation for the rest, with DataFrame functions only.

Rules decide where one fits. For every other url the host decides: personalised
PageRank carries trust from trusted seed hosts along links, and the same walk on
reversed links carries distrust from blocked seed hosts (a host that links to blocked
hosts is distrusted). A host whose distrust exceeds its trust by a factor is blocked.

Mass is held in integers, so a host's sums do not depend on the order in which rows
arrive and a recomputed task gives the same verdicts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.session import cut, drop_cut

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Most hosts whose mass is broadcast, of some 50 bytes each; beyond it hosts are copied to so many salts, and pages dealt over them.
BROADCAST_HOSTS, SALTS = 500_000, 32
#: Total mass of one walk, in integer units.
UNITS = 10**15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of rule and verdict of the longest fitting rule, else null.

    A rule fits its host and all subdomains of it, if the path begins with the rule's.
    Length counts host and path; of equal lengths the longer host wins, then block.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2])) for r in ordered]
    said = [F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict")) for r in ordered]
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(list(zip(fits, said, strict=True))), nothing)


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct ``src``, ``dst`` hosts of absolute links in whole pages, links within a host left out."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^"'\s>]+)"""), F.lit(1))
    # Distinct inside the page first: what leaves a page is its hosts, not its links.
    hosts = F.array_distinct(F.transform(links, url_host))
    found = pages.select(url_host(F.col(url)).alias("src"), F.explode(hosts).alias("dst"))
    return found.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: int = 85, rounds: int = 10) -> DataFrame:
    """Personalised PageRank: ``host`` and ``mass`` (long, of about UNITS in all), from ``src``, ``dst`` and the seeds' ``host``.

    ``damping`` is in hundredths. Each round sends that part of a host's mass along its
    links in equal shares; the rest, and the mass of hosts without links, returns to
    the seeds. No seeds: no rows. Each round is written to the shared folder, so
    lineage does not grow and a lost executor costs one round at most.
    """
    seeds = seeds.select("host").distinct()
    n = seeds.count()
    if not n:
        return seeds.select("host", F.lit(0).cast("long").alias("mass"))
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    ranked = seeds.select("host", F.lit(UNITS // n).cast("long").alias("mass"))
    if edges.isEmpty():
        return ranked
    linked = cut(edges.join(degrees, "src"))
    for _ in range(rounds):
        sent = ranked.join(linked, ranked["host"] == linked["src"]).select(F.col("dst").alias("host"), F.expr(f"(mass div 100 * {damping}) div degree").alias("mass"))
        kept = sent.agg(F.coalesce(F.sum("mass"), F.lit(0))).collect()[0][0]
        base = seeds.select("host", F.lit((UNITS - kept) // n).cast("long").alias("mass"))
        before, ranked = ranked, cut(sent.unionByName(base).groupBy("host").agg(F.sum("mass").alias("mass")))
        drop_cut(before)
    return ranked


def with_mass(pages: DataFrame, mass: DataFrame) -> DataFrame:
    """Pages with their host's columns of ``mass`` (a row for each host): no exchange of pages while hosts are few, else one that is salted."""
    if mass.count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(mass), "host", "left")
    copies = mass.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(copies, ["host", "__salt"], "left").drop("__salt")


def judge(pages: DataFrame, rules: Sequence[Rule], *, trusted: Sequence[str] = (), blocked: Sequence[str] = (), url: str = "url", html: str = "html", factor: int = 1, damping: int = 85, rounds: int = 10) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` (long).

    Seeds: the named hosts, and every host of the table that rules decide wholly: a
    host all of whose pages are allowed by rules is trusted, one all of whose pages are
    blocked by rules is blocked. A rule for a part of a host says nothing about the rest
    of it. A url that no rule fits is blocked if
    its host's distrust exceeds ``factor`` times its trust, else allowed.

    Null urls and urls without ``://`` have an empty host, which no rule fits and no
    link reaches: allowed. Null html has no links. Repeated rows are judged each.
    Empty tables give no rows. Columns of the result's names are replaced. A host's
    pages may be any share of the table: they never meet in one task.
    """
    names = ["host", "path", "rule", "verdict", "trust", "distrust"]
    judged = pages.drop(*[c for c in names if c not in (url, html)])
    judged = judged.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    judged = judged.withColumn("__rule", match_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(F.col("__rule.verdict"), F.lit("none"))
    said = judged.where("host != ''").groupBy("host").agg(F.min(by_rule).alias("verdict"), F.max(by_rule).alias("other"))
    said = cut(said.where((F.col("verdict") == F.col("other")) & (F.col("verdict") != "none")).select("host", "verdict"))
    spark = pages.sparkSession
    # The hosts that rules decide, and the named ones, where there are any.
    seeds = lambda kind, hosts: said.where(F.col("verdict") == kind).select("host").unionByName(spark.createDataFrame([(h,) for h in hosts], "host string")) if hosts else said.where(F.col("verdict") == kind).select("host")
    edges = cut(host_edges(pages, url=url, html=html))
    trust = propagate(edges, seeds("allow", trusted), damping=damping, rounds=rounds)
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(reverse, seeds("block", blocked), damping=damping, rounds=rounds)
    mass = trust.select("host", F.col("mass").alias("trust"), F.lit(0).cast("long").alias("distrust")).unionByName(distrust.select("host", F.lit(0).cast("long").alias("trust"), F.col("mass").alias("distrust")))
    mass = mass.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    joined = with_mass(judged, cut(mass)).withColumn("trust", F.coalesce(F.col("trust"), F.lit(0))).withColumn("distrust", F.coalesce(F.col("distrust"), F.lit(0)))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("distrust") > F.col("trust") * factor, "block").otherwise("allow"))
    return joined.withColumn("rule", F.col("__rule.rule")).withColumn("verdict", verdict).drop("__rule")
