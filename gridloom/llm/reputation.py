"""Empirical-Bayes host reputation: page outcomes shrunk through beta-binomial priors from host to registered domain to suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A page is allowed if its host's mean outcome, less so many standard deviations, reaches the bound.
DEVIATIONS, BOUND = 1.645, 0.5
#: A table of hosts up to this size goes to every task; a larger one is joined by salted keys.
BROADCAST_HOSTS, SALTS = 50_000, 32
#: Suffixes of two labels that domains are registered under, of 22 lands; all others are taken to have one label. A parameter of domain_of and suffix_of.
SUFFIXES = tuple(f"{kind}.{land}" for land, kinds in {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi maori net org school",
    "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "cn": "ac com edu gov net org", "tw": "com edu gov idv net org",
    "hk": "com edu gov idv net org", "in": "ac co edu firm gen gov ind net org", "br": "com edu gov net org", "ar": "com edu gob net org",
    "mx": "com edu gob net org", "za": "ac co gov net org web", "tr": "bel com edu gov k12 net org", "il": "ac co gov k12 net org", "id": "ac co go net or sch web",
    "th": "ac co go in net or", "my": "com edu gov net org", "sg": "com edu gov net org", "ph": "com edu gov net org", "pl": "com edu gov net org", "ua": "com edu gov net org",
}.items() for kind in kinds.split())
_ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without what may stand around it: user names before an "@", a port, a last dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it. An address is a domain of its own."""
    name = name_of(host)
    labels = F.when(F.substring_index(name, ".", -2).isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(name.rlike(_ADDRESS), name).otherwise(labels)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """What domains are registered under. Addresses have one in common."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), "(address)").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in first]
    return tuple(F.coalesce(*[F.when(fit, F.lit(value)) for fit, value in zip(fits, values)]) for values in ([h + p for _, h, p in first], [v for v, _, _ in first]))


def _strength(groups: DataFrame) -> DataFrame:
    """Mean and strength (alpha + beta) of the beta prior that groups of outcomes (n, good) have in common, by moments."""
    sums = groups.agg(F.sum("good").alias("x"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("pp"))
    mean = F.col("x") / F.col("t")
    spread = (F.col("pp") - F.col("t") * mean * mean - (F.col("k") - 1) * mean * (1 - mean)) / (F.col("t") - F.col("nn") / F.col("t"))
    bounded = F.when((F.col("t") * F.col("t") > F.col("nn")) & (spread > 0), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / spread - 1))).otherwise(F.lit(1000.0))
    return sums.select(F.coalesce(mean, F.lit(0.5)).alias("mean"), F.coalesce(bounded, F.lit(1000.0)).alias("strength"))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """Posterior of every host: host, mean, deviation, n. hosts: (host, n, good), one row for each, n 0 for unseen ones.

    The suffix is shrunk towards all outcomes, the domain towards its suffix and the
    host towards its domain; each level's prior strength is estimated from the level.
    """
    named = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    prior = {name: _strength(level.where("n > 0")).selectExpr(f"mean as mean_{name}", f"strength as strength_{name}") for name, level in (("s", suffixes), ("d", domains), ("h", named))}
    posterior = lambda mean, strength: (F.col("good") + mean * strength) / (F.col("n") + strength)
    one = F.broadcast(prior["s"].join(prior["d"]).join(prior["h"]))  # three single rows
    top = suffixes.join(one).select("suffix", posterior(F.col("mean_s"), F.col("strength_s")).alias("top"))
    middle = domains.join(one).join(top, "suffix").select("domain", posterior(F.col("top"), F.col("strength_d")).alias("middle"))
    joined = named.join(one).join(middle, "domain").withColumn("mean", posterior(F.col("middle"), F.col("strength_h")))
    return joined.select("host", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength_h") + 1)).alias("deviation"), "n")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, deviations: float = DEVIATIONS, bound: float = BOUND, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Verdict on every page's url: page_id, host, path, rule, verdict.

    pages: page_id, url. outcomes: (url, good), one row for each judged page, good 1
    or 0; rows without either are no outcomes. A rule's verdict comes first. Hosts
    that nothing is known of take their domain's or suffix's reputation. A null url,
    or one without "://", has an empty host and path, which form a host of their own.
    Repeated pages give repeated rows; very long urls are read whole, further columns,
    whatever their names, are left out, and a table without pages gives no rows. Hosts
    are counted once, written, and read for each level. Outcomes are counted per host before anything
    is joined, and the join is by broadcast or by salted hosts, so a host that holds
    a third of all pages is spread over many tasks.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = outcomes.where("url is not null and good is not null").select(host_of(F.col("url")).alias("host"), F.col("good").cast("long").alias("good"), F.lit(1).alias("n"))
    every = seen.unionByName(urls.select("host", F.lit(0).cast("long").alias("good"), F.lit(0).alias("n")))
    hosts = materialize(every.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    judged = host_reputation(hosts).select("host", F.when(F.col("mean") - deviations * F.col("deviation") >= bound, "allow").otherwise("block").alias("by_host"))
    if hosts.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        joined = urls.join(F.broadcast(judged), "host", "left")
    else:
        salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = urls.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host")).alias("verdict"))
