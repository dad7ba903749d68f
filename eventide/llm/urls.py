"""URL filters by host reputation: labelled pages, shrunk from suffix to domain to host.

Every level has a beta prior around the mean of the level above it: the corpus for a suffix, the
suffix for a registered domain, the domain for a host. How strongly a level leans on its prior is
estimated from all its members (moments of the beta-binomial), so a host with few labels follows its
domain and one with many speaks for itself. A host is blocked when even the upper bound of its share
of good pages is below the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.store import settle

# Second-level labels under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
MIN_GOOD = 0.5
DEVIATIONS = 2.0
# Bounds of a prior's weight, in labelled pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    """From after the first ``://`` to the next of ``/?#``, ASCII letters lower-cased."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels, three under such suffixes as ``co.uk``; an address is its own domain."""
    second = "|".join(SECOND_LEVEL)
    deep = F.regexp_extract(host, rf"([^.]+\.(?:{second})\.[a-z][a-z])$", 1)
    flat = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return (F.when(host.rlike(r"^[0-9.]+$"), host).when(deep != "", deep)
            .when(flat != "", flat).otherwise(host))


def suffix(domain: Column) -> Column:
    """What follows the first label of a registered domain; nothing for an address."""
    return F.when(domain.rlike(r"^[0-9.]+$"), F.lit("")).otherwise(
        F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """``name`` (host and path) or ``verdict`` of the longest rule that fits, else null."""
    fit = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        value = rule.verdict if field == "verdict" else rule.host + rule.path
        under = (host == rule.host) | host.endswith("." + rule.host)
        fit = F.when(under & path.startswith(rule.path), F.lit(value)).otherwise(fit)
    return fit


def _shrink(level: DataFrame, key: list[str], above: Sequence[str], prior: Column) -> DataFrame:
    """Posterior of each key: beta prior around ``prior`` with a weight shared by all siblings.

    The weight is the method-of-moments estimate for the beta-binomial over all keys: how much
    more the keys differ from their priors than chance alone would make them.
    """
    n, good = F.col("n"), F.col("good")
    noise = F.col("prior") * (1 - F.col("prior"))
    level = level.withColumn("prior", prior)
    moments = level.agg(
        F.sum(F.pow(good - n * F.col("prior"), 2)).alias("seen"),
        F.sum(n * noise).alias("chance"),
        F.sum(n * (n - 1) * noise).alias("room"),
    )
    # seen = chance + room / (weight + 1), in expectation.
    excess = F.col("seen") - F.col("chance")
    weight = F.when(excess > 0, F.col("room") / excess - 1).otherwise(F.lit(MOST_WEIGHT))
    bounded = F.greatest(F.lit(LEAST_WEIGHT), F.least(
        F.lit(MOST_WEIGHT), F.coalesce(weight, F.lit(MOST_WEIGHT))))
    return level.withColumn("weight", moments.select(bounded).scalar()).select(
        *key, *above,
        (F.col("weight") * F.col("prior") + good).alias("a"),
        (F.col("weight") * (1 - F.col("prior")) + n - good).alias("b"),
    )


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, good_share, upper) from (host, good), one row per known host.

    ``good`` is 1, 0, or null for a page without a label.
    """
    domain = registered_domain(F.col("host"))
    hosts = settle(
        outcomes.groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
        .withColumn("domain", domain).withColumn("suffix", suffix(F.col("domain")))
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    corpus = suffixes.agg(
        ((F.sum("good") + 0.5) / (F.sum("n") + 1.0)).alias("corpus"))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    by_suffix = _shrink(suffixes, ["suffix"], [], corpus.scalar()).select(
        "suffix", mean.alias("suffix_mean"))
    by_domain = _shrink(domains.join(by_suffix, "suffix"), ["domain"], [], F.col("suffix_mean")).select(
        "domain", mean.alias("domain_mean"))
    by_host = _shrink(hosts.join(by_domain, "domain"), ["host"], ["domain", "suffix", "n"],
                      F.col("domain_mean"))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return by_host.select(
        "host", "domain", "suffix", "n", mean.alias("good_share"),
        (mean + F.lit(DEVIATIONS) * deviation).alias("upper"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule],
               min_good: float = MIN_GOOD) -> DataFrame:
    """(page_id, host, path, rule, verdict, good_share, upper), one row per row of ``pages``.

    ``labels`` has (page_id, good) with good 1 or 0; a page labelled more than once counts as good
    only if all its labels say so, and labels of unknown pages or without a value count for nothing.
    A rule decides where one fits; else a page is blocked when the upper bound of its host's good
    share is below ``min_good``. Without any labels nothing is blocked but by rule. A null url, or
    one without ``://``, has an empty host and path and is judged like any other host. Repeated
    pages are each judged, and each counts as an outcome. Other columns are not read.
    """
    named = pages.select("page_id", url_host(F.col("url")).alias("host"),
                         url_path(F.col("url")).alias("path"))
    marks = labels.groupBy("page_id").agg(F.min("good").alias("good"))
    reputation = host_reputation(named.select("page_id", "host").join(marks, "page_id", "left"))
    host, path = F.col("host"), F.col("path")
    bad = F.coalesce(F.col("upper") < F.lit(min_good), F.lit(False))
    method = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return named.join(reputation.select("host", "good_share", "upper"), "host", "left").select(
        "page_id", "host", "path",
        fitting_rule(host, path, rules, "name").alias("rule"),
        F.coalesce(fitting_rule(host, path, rules, "verdict"), method).alias("verdict"),
        "good_share", "upper",
    )
