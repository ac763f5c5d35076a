"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled pages give each host good and bad outcomes. A beta-binomial prior is handed down: the shares over all labels are
the prior of a suffix, a suffix's posterior mean that of its registered domains, a domain's that of its hosts. How much a
parent's mean weighs (the prior's strength) is estimated at each level by moments from the spread of the children's rates.
A page is blocked where the lower bound of its host's posterior bad share exceeds a limit; a host without labels has its
nearest known ancestor's posterior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.sources.stage import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUFFIX_LABELS = 1  # labels of a public suffix; a registered domain has one more
LIMIT = 0.5  # bad share above which a host is blocked
Z = 1.6448536269514722  # one-sided 95 %
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; of rules of one length the first in the alphabet.

    ``rules`` are (verdict, rule) where rule is host and path in one, as ``example.net/en/``. A rule fits its host and all
    subdomains if the url's path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(set(rules), key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _handed_down(children: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Posterior (alpha, beta) of each child with its parent's posterior mean as the prior mean.

    Strength by moments: over the children, the variance of the rates around the parent's mean is that of binomial draws
    times 1 + (n - 1) / (strength + 1). Children that don't spread more than that get the greatest strength.
    """
    prior = materialise(children.join(parents.select(parent, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean")), parent))
    binomial = F.col("mean") * (1 - F.col("mean"))
    square = F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) / F.col("n")
    moments = prior.filter("n > 1").agg(F.sum(square - binomial).alias("excess"), F.sum((F.col("n") - 1) * binomial).alias("room"))
    by_moments = F.least(F.greatest(F.col("room") / F.col("excess") - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))
    strength = moments.select(F.when((F.col("excess") > 0) & (F.col("room") > 0), by_moments).otherwise(F.lit(MOST_STRENGTH)).alias("strength")).scalar()
    s = F.col("strength")
    return (prior.withColumn("strength", strength)
            .select(*dict.fromkeys((key, parent)), "n", "bad", (s * F.col("mean") + F.col("bad")).alias("alpha"),
                    (s * (1 - F.col("mean")) + F.col("n") - F.col("bad")).alias("beta")))


def reputations(outcomes: DataFrame, suffix_labels: int = SUFFIX_LABELS, z: float = Z) -> DataFrame:
    """One row per host: host, n, bad, bad_share, bad_bound. ``outcomes``: host and bad (1, 0 or null where not labelled)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialise(hosts.withColumns({"domain": last_labels(F.col("host"), suffix_labels + 1), "suffix": last_labels(F.col("host"), suffix_labels)}))
    domains = materialise(hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = materialise(domains.groupBy("suffix").agg(F.lit("").alias("root"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    root = suffixes.agg(F.lit("").alias("root"), (F.sum("bad") + 1).alias("alpha"), (F.sum("n") - F.sum("bad") + 1).alias("beta"))
    of_suffix = _handed_down(suffixes, "suffix", root, "root")
    of_domain = _handed_down(domains, "domain", of_suffix, "suffix")
    of_host = _handed_down(hosts.drop("suffix"), "host", of_domain, "domain")
    total = F.col("alpha") + F.col("beta")
    share = F.col("alpha") / total
    return of_host.select("host", "n", "bad", share.alias("bad_share"), (share - z * F.sqrt(share * (1 - share) / (total + 1))).alias("bad_bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], limit: float = LIMIT, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``outcomes``: url and bad (1 or 0) of labelled pages. A null url, or one without ://, has an empty host and path, which
    is a host like any other. Repeated rows are judged each; without labels the method allows all. Other columns are ignored.
    """
    u = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    u = u.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("int").alias("bad"))
    seen = seen.unionByName(u.select("host", F.lit(None).cast("int").alias("bad")))
    blocked = materialise(reputations(seen).filter(F.col("bad_bound") > limit).select("host", F.lit(True).alias("blocked")))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return u.join(blocked, "host", "left").withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"))
