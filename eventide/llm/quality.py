"""Quality rules: robust multivariate outliers per language and source.

Three statistics that every prose text has, transformed to be roughly symmetric, make a vector: how
long its different words are, how much that varies, and how many other characters they carry.
For each language and source the minimum covariance determinant estimates where most of its documents
lie: from the medians, with spreads by quartiles or by variances, the center and covariance of the
``SHARE`` of documents closest by Mahalanobis distance are worked out again and again, and of both
ends the one with the smaller determinant is taken. Equal vectors count once, so that copies, however many, do not pull the estimate together.

Small sources borrow: an estimate of n documents is averaged with that of its language at the weight
of ``PRIOR`` documents, the language's with that of everything, and that with the plain covariance of
all documents, which rejects nobody where there are few. A document is measured against the spread of
its group and the sampling noise of its own statistics, which is large for short texts; those too far
from their group's center are rejected.

Distances are counted in bins, so the closest share is found by adding up counts: no group is sorted
or gathered, and the result does not depend on how rows were spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.store import let, settle, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Characters that are no letters, in ASCII and the punctuation common in prose.
NO_LETTERS = ("0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
              "\u00a0¡§«°±²³·¹»¿×÷‐–—―‘’‚“”„†•…‰′″‹›€、。「」！（），：；？")
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

STATISTICS = ("word_length", "marks", "variety")
# Half, so that the estimates hold as long as fewer than half of a group's rows are outliers.
SHARE = 0.5
# Makes the covariance of the closest half of a normal sample in three dimensions that of all of it.
CONSISTENCY = 2.458
STEPS = 3
# Documents that the next wider estimate counts for.
PRIOR = 64
# Squared distance beyond which one in a million of a normal sample lies: chi-square, three dimensions.
CUTOFF = 30.665
# Added to variances so that they have a square root; a standard deviation of a thousandth.
RIDGE = 1e-6
# Languages and sources up to which their estimates, one row each, are broadcast; more are joined.
FEW_GROUPS = 10_000

_P = len(STATISTICS)
_PAIRS = list(combinations_with_replacement(range(_P), 2))
_GROUP = ["lang", "source"]
# Bins of a statistic's quantiles in a unit.
_FINE = 256
_COVARIANCE = [f"c{i}{j}" for i, j in _PAIRS]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("hash"), i.alias("at")))

    def repeated(s: Column) -> Column:
        same = lambda x, other: F.coalesce(x["hash"] == F.get(s, other)["hash"], F.lit(False))
        return F.array_sort(F.transform(
            F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

    # Each window adds the words by which it reaches beyond the one before.
    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda state, x: F.struct(
            x.alias("last"), (state["n"] + F.least(F.lit(3), x - state["last"])).alias("n")),
            lambda state: state["n"])

    return let(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(
        let(F.array_sort(windows(w)), lambda s: covered(repeated(s)))))


def _prose(words: Column) -> Column:
    """Of the different words with a letter: how many there are, the sums of their letters and of the
    squares of these, and the other characters in them."""
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("_kinds", "_letters", "_squares", "_marks")])

    def add(s: Column, w: Column) -> Column:
        some = (w["n"] > 0).cast("int")
        return F.struct((s["_kinds"] + some).alias("_kinds"), (s["_letters"] + w["n"]).alias("_letters"),
                        (s["_squares"] + w["n"] * w["n"]).alias("_squares"),
                        (s["_marks"] + some * (w["chars"] - w["n"])).alias("_marks"))

    # Sizes first, so that each word is spelled out once.
    sizes = F.transform(F.array_distinct(words), lambda w: F.struct(
        F.char_length(F.translate(w, NO_LETTERS, "")).alias("n"), F.char_length(w).alias("chars")))
    return F.aggregate(sizes, start, add)


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts of each text beside its other columns."""
    text = text_or_empty()
    solid = F.translate(text, BLANKS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    return docs.select(
        "*",
        let(_words(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).cast("long").alias("n_repeat_words"), _prose(w).alias("_prose"))).alias("_counts"),
        F.char_length(solid).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("*", "_counts.*", "_counts._prose.*").drop("_counts", "_prose")


def _vector(p: str = "z") -> list[Column]:
    return [F.col(f"{p}{i}") for i in range(_P)]


def _statistics() -> list[Column]:
    """The transformed statistics, and the variance that sampling alone gives each of them.

    Everything is counted as if there were one more, so that a text without letters has a vector too.
    """
    kinds, marks = F.col("_kinds") + 1.0, F.col("_marks") + 1.0
    mean = (F.col("_letters") + 1.0) / kinds
    # Lengths are whole numbers, which adds the variance of rounding.
    spread = F.greatest((F.col("_squares") + 1.0) / kinds - mean * mean, F.lit(0.0)) + F.lit(1 / 12)
    values = (F.ln(mean), F.ln(marks / kinds), F.ln(spread) / 2)
    noise = (spread / (kinds * mean * mean), 1 / marks, 1 / (2 * kinds))
    return [x.alias(f"{p}{i}") for p, xs in (("z", values), ("s", noise)) for i, x in enumerate(xs)]


def _quantile(rows: DataFrame, key: list[str], value: Column, per_unit: int, share: float) -> DataFrame:
    """Per key the first bin of ``value`` by which ``share`` of its rows are reached.

    Bins are counted before they are shuffled, and there are only so many of them.
    """
    bins = rows.groupBy(*key, F.floor(value * per_unit).alias("bin")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))
    every = F.sum("n").over(Window.partitionBy(*key))
    reached = bins.withColumn("reached", so_far >= F.lit(share) * every)
    return reached.filter("reached").groupBy(*key).agg(F.min("bin").alias("bin"))


def _moments(rows: DataFrame, key: list[str], factor: float) -> DataFrame:
    """Center and covariance, times ``factor``, of each group, and how many rows it has."""
    z = _vector()
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(z)]
    products = [F.avg(z[i] * z[j]).alias(f"p{i}{j}") for i, j in _PAIRS]
    covariance = [
        ((F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
         + F.lit(RIDGE if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*key).agg(*sums, *products, F.count("*").alias("n")).select(
        *key, "n", *_vector("m"), *covariance)


def _with_factor(estimates: DataFrame) -> DataFrame:
    """The lower Cholesky factor of the covariance beside each row, and its determinant."""
    out = estimates
    for i in range(_P):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}") - sum(
                (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            # Rounding may leave a little less than nothing.
            root = F.sqrt(F.greatest(rest, F.lit(RIDGE / 100)))
            out = out.withColumn(f"l{i}{j}", root if i == j else rest / F.col(f"l{j}{j}"))
    determinant = reduce(lambda a, b: a * b, [F.col(f"l{i}{i}") for i in range(_P)])
    return out.withColumn("determinant", determinant)


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution; the factor's columns are at hand."""
    solved: list[Column] = []
    for i in range(_P):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


def _join_groups(rows: DataFrame, groups: DataFrame, key: list[str], few: bool) -> DataFrame:
    """Give each row what is known of its group; ``few`` says that the groups were counted and fit."""
    return rows.join(F.broadcast(groups) if few else groups, key)


def robust_estimates(rows: DataFrame, few: bool = False) -> DataFrame:
    """Center, covariance and rows of each group of rows (lang, source, z0, ...), by two starts."""
    key, axis = [*_GROUP, "start"], [*_GROUP, "axis"]
    z = F.array(*[F.struct(F.lit(i).alias("axis"), x.alias("value")) for i, x in enumerate(_vector())])
    values = rows.select(*_GROUP, F.inline(z))
    middle, low, high = (_quantile(values, axis, F.col("value"), _FINE, share).withColumnRenamed("bin", name)
                         for share, name in ((0.5, "middle"), (0.25, "low"), (0.75, "high")))
    # Between the quartiles of a normal sample lie 1.349 standard deviations.
    scale = F.greatest(F.col("high") - F.col("low"), F.lit(1)) / F.lit(1.349 * _FINE)
    quartiles = middle.join(low, axis).join(high, axis).groupBy(*_GROUP).agg(
        *[F.max(F.when(F.col("axis") == i, (F.col("middle") + 0.5) / _FINE)).alias(f"m{i}") for i in range(_P)],
        *[F.max(F.when(F.col("axis") == i, scale * scale)).alias(f"q{i}") for i in range(_P)])
    whole = settle(_moments(rows, _GROUP, 1.0))

    def from_median(start: str, variance: str) -> DataFrame:
        return quartiles.join(whole.drop(*(f"m{i}" for i in range(_P))), _GROUP).select(
            *_GROUP, F.lit(start).alias("start"), "n", *_vector("m"),
            *[(F.col(variance.format(c[1])) if c[1] == c[2] else F.lit(0.0)).alias(c) for c in _COVARIANCE])

    starts = [from_median("quartiles", "q{0}"), from_median("variances", "c{0}{0}")]
    estimates = settle(starts[0].unionByName(starts[1]))
    both = rows.withColumn("start", F.explode(F.array(F.lit("quartiles"), F.lit("variances"))))
    sizes = whole.select(*_GROUP, "n")
    for _ in range(STEPS):
        # Bins of 1/32 in the logarithm of the distance.
        at = F.ln(F.col("distance") + 1e-6)
        far = _join_groups(both, _with_factor(estimates.drop("n")), key, few).withColumn("distance", _distance())
        reach = _quantile(far, key, at, 32, SHARE)
        closest = _join_groups(far, reach, key, few).filter(F.floor(at * 32) <= F.col("bin"))
        estimates = settle(_moments(closest, key, CONSISTENCY))
    best = F.min(F.struct("determinant", "start"))
    chosen = _with_factor(estimates).groupBy(*_GROUP).agg(best.alias("best")).select(
        *_GROUP, F.col("best.start").alias("start"))
    return estimates.drop("n").join(chosen, key).drop("start").join(sizes, _GROUP)


def _averaged(estimates: DataFrame, wider: DataFrame, key: list[str]) -> DataFrame:
    """Estimates, each averaged with the wider one of its ``key`` at the weight of ``PRIOR`` rows."""
    numbers = [*(f"m{i}" for i in range(_P)), *_COVARIANCE]
    names = wider.select(*key, *[F.col(c).alias(f"w_{c}") for c in numbers])
    share = F.col("n") / (F.col("n") + PRIOR)
    joined = estimates.join(names, key) if key else estimates.join(F.broadcast(names))
    return joined.select(*_GROUP, "n", *[
        (share * F.col(c) + (1 - share) * F.col(f"w_{c}")).alias(c) for c in numbers])


def references(rows: DataFrame, few: bool = False) -> DataFrame:
    """What rows (lang, source, z0, ...) of each language and source are measured against.

    Names start with ``=``; ``*`` stands for all.
    """
    every = F.lit("*")
    feeds = F.array(F.struct("lang", "source"), F.struct("lang", every.alias("source")),
                    F.struct(every.alias("lang"), every.alias("source")))
    vectors = rows.select(*_GROUP, *_vector()).distinct()
    fed = settle(vectors.select(F.explode(feeds).alias("group"), *_vector()).select("group.*", *_vector()))
    estimates = settle(robust_estimates(fed, few))
    plain = _moments(vectors, [], 1.0)
    of_all = F.col("lang") == "*"
    of_language = ~of_all & (F.col("source") == "*")
    everything = settle(_averaged(estimates.filter(of_all), plain, []))
    languages = settle(_averaged(estimates.filter(of_language), everything.drop(*_GROUP), []))
    return _averaged(estimates.filter(F.col("source") != "*"), languages.drop("source", "n"), ["lang"])


def judge_quality(docs: DataFrame, cutoff: float = CUTOFF, min_words: int = MIN_WORDS,
                  also: Sequence[Column] = ()) -> DataFrame:
    """Counts and verdict per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance.

    Rows fail at once with fewer than ``min_words`` words or more than half of their words in
    repeated windows; the others are measured against their language and source. With few such rows
    in all, none is rejected. A null text counts as empty; a null language or source is a group like
    any other. Repeated rows each get the same verdict and teach as one. An empty table gives an empty
    result. Only doc_id, text, lang and source are read. ``also`` are columns of ``docs`` to carry.
    """
    named = [F.concat(F.lit("="), F.coalesce(F.col(c), F.lit(""))).alias(c) for c in _GROUP]
    counted = text_statistics(docs.select("doc_id", "text", *named, *also)).drop("text")
    failed = (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words"))
    rows = settle(counted.withColumn("base_failed", failed).select("*", *_statistics()))

    sound = rows.filter(~F.col("base_failed"))
    # Every estimate twice, and those of languages.
    few = sound.select(*_GROUP).distinct().count() * 4 <= FEW_GROUPS
    estimates = settle(references(sound, few))
    noisy = [(F.col(c) + F.col(f"s{c[1]}") if c[1] == c[2] else F.col(c)).alias(c) for c in _COVARIANCE]
    carried = [c for c in counted.columns if c not in _GROUP and not c.startswith("_")]
    counts = [*carried, "base_failed"]
    measured = _join_groups(sound, estimates.drop("n"), _GROUP, few).select(
        *counts, *_vector(), *_vector("m"), *noisy)
    judged = _with_factor(measured).withColumn("distance", _distance())
    return judged.select(*counts, (F.col("distance") <= cutoff).alias("kept"), "distance"
                         ).unionByName(rows.filter("base_failed").select(
                             *counts, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))


def sound_documents(docs: DataFrame, cutoff: float = CUTOFF, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs`` that `judge_quality` keeps, unchanged."""
    rejected = judge_quality(docs, cutoff, min_words, [F.xxhash64("text", "lang", "source").alias("body")]
                             ).filter(~F.col("kept")).select("doc_id", "body").distinct()
    same = docs["doc_id"].eqNullSafe(rejected["doc_id"]) & (
        F.xxhash64(docs["text"], docs["lang"], docs["source"]) == rejected["body"])
    return docs.join(rejected, same, "left_anti")
