"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mix, and so a mean number of times that each of its documents
is to appear. A document's own number is the Poisson distribution with that mean, inverted at a
uniform number made from its id and text; all copies are then shuffled globally.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.store import let, settle, text_or_empty

SEED = 17
# Numbers, in the distribution functions of all sources, up to which these are broadcast: 32 MB.
FEW_NUMBERS = 4_000_000
# A distribution function is summed so many deviations, and numbers, to both sides of its mean.
_DEVIATIONS, _AT_LEAST = 12, 40
# Copies of a row that one task makes at most before others share in.
_AT_ONCE = 1024

def uniform(*parts: Column) -> Column:
    """A number in [0, 1) made of 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _log_factorial(k: Column) -> Column:
    """By Stirling's series, to a part in 10**13, where factorials are no longer long integers."""
    x = k.cast("double")
    series = x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(k <= 20, F.ln(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """(source, first, cdf): P(X <= k) for k = first, first + 1, ... as far as doubles can tell.

    There are some 24 sqrt(rate) numbers, around the mean; what lies below is less than 10**-30.
    """
    reach = _DEVIATIONS * F.sqrt("rate") + _AT_LEAST
    first = F.greatest(F.floor(F.col("rate") - reach), F.lit(0).cast("long"))
    ks = rates.select("source", "rate", F.explode(F.sequence(first, F.floor(F.col("rate") + reach))).alias("k"))
    chance = F.when(F.col("rate") > 0, F.exp(
        F.col("k") * F.ln("rate") - F.col("rate") - _log_factorial(F.col("k")))).otherwise(
            (F.col("k") == 0).cast("double"))
    summed = F.sum(chance).over(Window.partitionBy("source").orderBy("k"))
    found = ks.select("source", "k", summed.alias("upto")).groupBy("source").agg(
        F.min("k").alias("first"), F.array_sort(F.collect_list("upto")).alias("cdf"))
    return found


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """(source, chars, rate): how often each document of a source is to appear on average.

    Target shares are ``weights`` brought to a sum of 1 over the sources that hold text, equal ones
    by default; a source not named gets none. The mix is as large as the input, in code points. A
    source of empty texts alone keeps each of its documents once. A null source is one of its own.
    """
    sizes = docs.groupBy("source").agg(
        F.sum(F.char_length(text_or_empty())).cast("double").alias("chars"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for source, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(share))).otherwise(weight)
    sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    totals = sizes.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight"))
    all_chars, all_weight = (totals.select(c).scalar() for c in ("chars", "weight"))
    rate = F.col("weight") / F.nullif(all_weight, F.lit(0.0)) * all_chars / F.nullif("chars", F.lit(0.0))
    return sizes.select("source", "chars", F.when(F.col("chars") > 0, F.coalesce(rate, F.lit(0.0)))
                        .otherwise(F.lit(1.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None,
                seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` repeated by Poisson counts, in a random global order.

    ``copy`` (from 1) and ``shuffle_key`` are added, in place of columns of those names. A row's
    count depends on its source's rate, its doc_id and text, and the seed: a lost task repeats it,
    rows of one doc_id, or of none, are drawn apart, and rows that agree in both share a count. An
    empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rates = settle(source_rates(docs, weights))
    cdf = settle(poisson_cdf(rates))
    if (cdf.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= FEW_NUMBERS:
        cdf = F.broadcast(cdf)
    body = F.md5(text_or_empty())
    named = F.concat_ws(":", F.lit(seed + 1), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), body)
    # Numbered, so that no name of the input meets one of the join.
    numbered = [f"_{i}" for i in range(len(others))]
    own = docs.select(F.col("source").alias("_source"), uniform(F.lit(seed), F.col("doc_id"), body).alias("at"),
                      named.alias("name"), F.monotonically_increasing_id().alias("salt"),
                      *[F.col(c).alias(n) for c, n in zip(others, numbered, strict=True)])
    count = let(F.col("at"), lambda at: F.col("first") + F.size(F.filter("cdf", lambda x: x <= at)))
    row = [*numbered, "name", "salt"]
    counted = own.join(cdf, F.col("_source").eqNullSafe(F.col("source"))).select(*row, count.alias("count"))
    one = F.lit(1).cast("long")
    few = counted.filter(F.col("count").between(1, _AT_ONCE)).select(
        *row, F.explode(F.sequence(one, "count")).alias("copy"))
    # Very many copies of a row are dealt out in parts first.
    parts = counted.filter(F.col("count") > _AT_ONCE).select("*", F.explode(F.sequence(
        one, "count", F.lit(_AT_ONCE).cast("long"))).alias("from"))
    many = parts.repartition("salt", "from").select(*row, F.explode(F.sequence(
        "from", F.least(F.col("from") + (_AT_ONCE - 1), F.col("count")))).alias("copy"))
    # The salt parts rows that are equal in all the rest.
    mixed = few.unionByName(many).withColumn("shuffle_key", F.md5(F.concat_ws(":", "name", "copy"))).orderBy("shuffle_key", "copy", "salt")
    return mixed.select(*[F.col(n).alias(c) for c, n in zip(others, numbered, strict=True)], "copy", "shuffle_key")
