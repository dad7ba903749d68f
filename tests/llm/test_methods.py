"""Operators against plain versions over the test tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import (
    jaccard,
    linked_classes,
    probability_jaccard,
    read_texts,
    shingle_counts,
    tokenizer_file,
    words,
)

import corpus_pipeline
from eventide.llm import bloom, components, exact, lines, mixing, neardup, packing, quality, queries, scoring, urls
from eventide.llm.store import settle
from eventide.llm.words import words as word_spans

Q = queries.queries()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return read_texts(spark, sf_dir)


def test_spans_by_brute_force(spark, sf_dir, texts):
    first = {}
    split = {d: words(t) for d, t in texts.items()}
    for d in sorted(split):
        for i in range(len(split[d]) - 49):
            first.setdefault(tuple(split[d][i:i + 50]), d)
    want = {}
    for d, w in split.items():
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < d for j in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q["op5_substring_dedup"](spark, sf_dir).collect()}
    assert got == want and sum(x[1] for x in want.values())


def test_near_duplicates_by_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r.class_id for r in Q["op8_near_duplicates"](spark, sf_dir).collect()}
    assert got == linked_classes(texts)


@pytest.mark.parametrize("rows", [2, 128])
def test_a_large_group_of_similar_texts(spark, monkeypatch, rows):
    """Variants of one text, some of which are near nothing and some only near each other."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    variants = {}
    for d in range(60):
        words_ = list(base)
        for at in rng.choice(24, 1 + d % 7, replace=False):
            words_[5 * at] = f"x{at}" if d % 3 else f"x{at}y{d}"
        variants[1000 - d] = " ".join(words_)
    docs = spark.createDataFrame(list(variants.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    want = linked_classes(variants)
    assert got == want and 1 < len(set(want.values())) < 60


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    a = np.arange(1, 301, dtype=np.uint64)
    b = np.arange(61, 361, dtype=np.uint64)
    count_a, count_b = rng.integers(1, 4, 300), rng.integers(1, 4, 300)
    size = 4000
    text = np.repeat([0, 1], 300)
    found = neardup.prob_min_hash(text, np.concatenate([a, b]), np.concatenate([count_a, count_b]), 2, size)
    want = probability_jaccard(Counter(dict(zip(a.tolist(), count_a.tolist()))),
                               Counter(dict(zip(b.tolist(), count_b.tolist()))))
    assert abs((found[0] == found[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / size)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}


def test_quality_by_plain_counts(spark, sf_dir, texts):
    for r in Q["op7_quality_rules"](spark, sf_dir).collect():
        text = texts[r.doc_id] or ""
        w = words(text)
        thrice = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if thrice[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        full = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def _plain_mcd(z):
    """The same concentration steps over one group."""
    ridge = quality.RIDGE * np.eye(3)

    def moments(x, factor):
        return x.mean(axis=0), np.cov(x.T, bias=True) * factor + ridge

    def distances(center, covariance):
        return np.einsum("ij,jk,ik->i", z - center, np.linalg.inv(covariance), z - center)

    def quantile(values, per_unit, share):
        return np.sort(np.floor(values * per_unit))[math.ceil(share * len(values)) - 1]

    ends = []
    low, middle, high = ([quantile(z[:, i], 256, share) for i in range(3)] for share in (0.25, 0.5, 0.75))
    median = (np.array(middle) + 0.5) / 256
    scale = np.maximum(np.array(high) - low, 1) / (1.349 * 256)
    for spread in (scale**2, np.diag(moments(z, 1.0)[1])):
        start = median, np.diag(spread)
        for _ in range(quality.STEPS):
            at = np.log(distances(*start) + 1e-6)
            start = moments(z[np.floor(at * 32) <= quantile(at, 32, quality.SHARE)], quality.CONSISTENCY)
        ends.append(start)
    return distances(*min(ends, key=lambda e: np.linalg.det(e[1])))


def _vectors(spark, z, source="a"):
    return spark.createDataFrame(
        [("en", source, i, *map(float, row)) for i, row in enumerate(z)],
        "lang string, source string, i long, z0 double, z1 double, z2 double").repartition(5)


def _distances(frame, estimates):
    joined = quality._with_factor(frame.join(estimates.drop("n"), ["lang", "source"]))
    return {r.i: r.distance for r in joined.withColumn("distance", quality._distance()).collect()}


def test_outliers_by_plain_estimates(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(400, 3)) * [1, 2, 0.5] + 3
    z[:60] += [40, 0, 9]
    frame = _vectors(spark, z)
    got = _distances(frame, quality.robust_estimates(frame.drop("i")))
    want = _plain_mcd(z)
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-6)
    assert all(want[:60] > quality.CUTOFF) and all(want[60:] < quality.CUTOFF)


@pytest.mark.parametrize(("share", "away", "spread"), [(0.33, 12, 0), (0.33, 45, 0.1), (0.45, 25, 0.1)])
def test_much_alike_junk_does_not_hide_itself(spark, share, away, spread):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(600, 3)) + 3
    junk = int(share * len(z))
    z[:junk] = 3 + away / 2 + spread * rng.normal(size=(junk, 3))
    frame = _vectors(spark, z)
    got = _distances(frame, quality.robust_estimates(frame.drop("i")))
    assert all((got[i] > quality.CUTOFF) == (i < junk) for i in range(len(z)))


def test_a_third_of_copies_does_not_narrow_the_rest(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(900, 3))
    z[:300] = 0.1
    frame = _vectors(spark, z)
    got = _distances(frame, quality.references(frame.drop("i")))
    assert all(d < quality.CUTOFF for d in got.values())


def test_the_covariance_decides(spark):
    """A vector inside of every single spread, but against the correlation, is an outlier."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    z = np.stack([x, x + 0.1 * rng.normal(size=500), rng.normal(size=500)], axis=1)
    z[0], z[1] = [1.5, -1.5, 0], [1.5, 1.5, 0]
    frame = _vectors(spark, z)
    got = _distances(frame, quality.references(frame.drop("i")))
    assert got[0] > quality.CUTOFF > got[1]


def _letters(rng, low, high, n=100, mark=""):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(low, high + 1))) + mark
                    for _ in range(n))


_QUALITY = "doc_id long, text string, lang string, source string"


def test_one_text_is_judged_by_the_spread_of_its_source(spark):
    rng = np.random.default_rng(8)
    rows = [(i, _letters(rng, 4, 6), "en", "narrow") for i in range(150)]
    for i in range(150):
        low = int(rng.integers(2, 9))
        rows.append((200 + i, _letters(rng, low, low + 2), "en", "wide"))
    text = _letters(rng, 8, 10)
    rows += [(500, text, "en", "narrow"), (501, text, "en", "wide")]
    judged = {r.doc_id: r.kept for r in quality.judge_quality(spark.createDataFrame(rows, _QUALITY)).collect()}
    assert not judged[500] and judged[501]
    assert all(kept for i, kept in judged.items() if i != 500)


def test_what_is_added_to_variances_is_small(spark, sf_dir):
    """In large groups the numerical floor is less than a tenth of each variance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality.text_statistics(docs.select("doc_id", "text", "lang", "source")).filter("n_words >= 50")
    vectors = rows.select("lang", F.lit("*").alias("source"), *quality._statistics()).filter("lang = 'en'")
    for r in quality.references(vectors).collect():
        assert all(r[f"c{i}{i}"] > 10 * quality.RIDGE for i in range(3))


def test_each_statistic_can_reject_alone(spark):
    rng = np.random.default_rng(4)
    odd = {"long words": _letters(rng, 8, 12), "marks": _letters(rng, 3, 7, mark="$$"),
           "words of one length": _letters(rng, 5, 5), "no letters": " ".join(map(str, range(10_000, 10_100)))}
    sound = [(i, _letters(rng, 3, 7), "en", "a") for i in range(60)]
    rows = sound + [(100 + i, text, "en", "a") for i, text in enumerate(odd.values())]
    judged = quality.judge_quality(spark.createDataFrame(rows, _QUALITY))
    got = {r.doc_id: (r.base_failed, r.kept) for r in judged.collect()}
    assert all(got[i] == (False, True) for i in range(60))
    assert {name: got[100 + i] for i, name in enumerate(odd)} == dict.fromkeys(odd, (False, False))


def test_prose_counts_by_plain_words(spark):
    texts = ["It's 42 -- fine, ½ «non»! It's fine, It's", "", " 1 2 3 ", "a a A b1 日本語 ??", "x" * 50 + "\t\x0b-y-"]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], _QUALITY)
    for r in quality.text_statistics(docs).collect():
        kinds = {w: sum(c not in quality.NO_LETTERS for c in w) for w in words(texts[r.doc_id])}
        kinds = {w: n for w, n in kinds.items() if n}
        assert (r._kinds, r._letters, r._squares, r._marks) == (
            len(kinds), sum(kinds.values()), sum(n * n for n in kinds.values()),
            sum(len(w) - n for w, n in kinds.items()))


def test_small_groups_are_measured_by_language_then_by_everything(spark):
    rng = np.random.default_rng(6)

    def text(low, high, mark=""):
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(low, high + 1))) + mark for _ in range(100))

    rows = [(i, text(3, 7), "en", "a") for i in range(170)]
    rows += [(170 + i, text(13, 17), "xx", f"s{i % 9}") for i in range(80)]
    # Small sources of junk, of a language with a large source, of one with small ones, of a rare one.
    rows += [(250 + i, text(3, 7, "$$$"), "en", "b") for i in range(30)]
    rows += [(300 + i, text(13, 17, "$$$$$$$$$"), "xx", "t") for i in range(20)]
    rows += [(400 + i, text(3, 7, "$$$$$$$$"), "de", "c") for i in range(5)]
    # One sound text of a source of its own, and one as sound elsewhere only.
    rows += [(500, text(3, 7), "en", "d"), (501, text(13, 17), "en", "d")]
    judged = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in judged.collect()}
    assert got == {d: (False, d < 250 or d == 500) for d, *_ in rows}


def test_a_small_source_of_junk_is_judged(spark):
    """However few rows all small groups have together."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    rows = [(i, " ".join(word() for _ in range(100)), "en", "a") for i in range(60)]
    rows += [(100 + i, " ".join(word() + "$$$" for _ in range(100)), "en", "b") for i in range(30)]
    judged = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id: r.kept for r in judged.collect()} == {d: d < 100 for d, *_ in rows}


def test_junk_is_rejected_and_prose_kept(spark, sf_dir, texts):
    prose = []
    for r in Q["op7_quality_rules"](spark, sf_dir).collect():
        if not r.base_failed and 5 * r.n_symbols > r.word_chars:
            assert not r.kept
        if not r.base_failed and not r.n_symbols:
            prose.append(r.kept)
    assert sum(prose) >= 0.99 * len(prose)


def test_scores_by_a_plain_model(spark, sf_dir, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*words((t or "").translate(low)), None] for d, t in texts.items()}
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d in tokens}

    def counts(without):
        one, two = Counter(), Counter()
        for d, ws in tokens.items():
            if fold[d] not in without:
                one.update(ws)
                two.update(zip([None, *ws], ws))
        return one, two

    def bucket(n):
        return int(math.log2(n)) + 1 if n else 0

    one, two = counts({2, 3})
    n, v, events = sum(one.values()), len(one), defaultdict(list)
    for d, ws in tokens.items():
        if fold[d] == 3:
            for before, w in zip([None, *ws], ws):
                events[bucket(one[before])].append((two[before, w] / max(one[before], 1), one[w] / n, 1 / (v + 1)))
    learned = [dict(zip(("bucket", "bigram", "unigram", "uniform"), (
        k, *scoring.interpolation_weights(np.array(e).T, np.ones(len(e)))))) for k, e in events.items()]
    weight = scoring._weight_table(learned)
    one, two = counts({2})
    n, v = sum(one.values()), len(one)
    # Blocks small enough that there are many.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = scoring.score_documents(docs, 100_000, 50_000).collect()
    assert len(got) == len(tokens)
    total = {"score": 0.0, "base": 0.0}
    for r in got:
        ws = tokens[r.doc_id]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for before, w in zip([None, *ws], ws):
            a, b, c = weight[:, bucket(one[before])]
            score += math.log10(a * two[before, w] / max(one[before], 1) + b * one[w] / n + c / (v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            fold[r.doc_id] == 2, len(ws), sum(one[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-3)
        if r.held_out:
            total["score"] += r.score
            total["base"] += r.base_score
    assert total["score"] > total["base"]


def test_probabilities_add_up_to_one():
    shares = np.array([[0.5, 0.0, 0.1], [0.2, 0.3, 0.1], [0.01, 0.01, 0.01]])
    weight = scoring.interpolation_weights(shares, np.array([3, 2, 1]))
    assert weight.sum() == pytest.approx(1) and (weight >= 0).all()
    assert scoring._weight_table(None).sum(axis=0) == pytest.approx(1)


def test_pieces_are_what_the_tokenizer_gives(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    odd = {-1: "a b ́c\x85d <|endoftext|>x<|startoftext|> İ Σς's 'LL 12\t3", -2: None, -3: "\n \n",
           -4: "é " * 3000}
    docs = spark.createDataFrame(list((texts | odd).items()), "doc_id long, text string")
    got = defaultdict(dict)
    for r in packing.cut_pieces(docs, tokenizer_file(), with_ids=True).collect():
        got[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == 2048 * r.piece and r.length == len(got[r.doc_id][r.start]) <= 2048
        assert zlib.crc32(r.ids) == r.ids_crc32
    for d, t in (texts | odd).items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert [x for _, part in sorted(got[d].items()) for x in part] == ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 3000)
    for capacity in (packing.Capacity(), packing.Capacity(2048, 3, 2_500_000 + 2048 * 2048)):
        sequence, offset = packing.best_fit(lengths, capacity, rule=rule)
        for name in np.unique(sequence):
            own = sequence == name
            order = np.argsort(offset[own])
            size = lengths[own][order]
            assert (offset[own][order] == np.cumsum(size) - size).all()
            assert size.sum() <= capacity.tokens and len(size) <= capacity.documents
            assert (size.astype(float) ** 2).sum() <= capacity.attention
    full = packing.best_fit(lengths, rule=rule)[0].max() + 1
    if rule == "norm":
        assert full <= 1.02 * math.ceil(lengths.sum() / 2048)


def test_packing_is_tight(spark, sf_dir):
    pieces = Q["op4_best_fit_packing"](spark, sf_dir).collect()
    total = sum(r.length for r in pieces)
    assert len({r.sequence_id for r in pieces}) <= 1.03 * math.ceil(total / 2048)


def test_frequent_digests_are_found(spark):
    rows = [("x" * 64,)] * 500 + [(f"{i:064}",) for i in range(1500)]
    digests = spark.createDataFrame(rows, "text_sha256 string").repartition(7)
    found = exact.heavy_digests(digests, heavy=3, counters=64).collect()
    assert len(found) <= 3 and "x" * 64 in {r.text_sha256 for r in found}


def test_filters_miss_nothing_that_was_seen_twice():
    rng = np.random.default_rng(2)
    twice = rng.integers(0, 2**63, 3000).astype(np.uint64)
    once = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    parts = [bloom.SeenTwice(8) for _ in range(3)]
    parts[0].add(np.concatenate([twice, once[:7000]]))
    parts[1].add(np.concatenate([twice[:1500], once[7000:14000]]))
    parts[2].add(np.concatenate([twice[1500:], once[14000:]]))
    whole = bloom.SeenTwice(8)
    for part in parts:
        for batch in part.rows():
            for row in batch.to_pylist():
                whole.merge(row["segment"], row["once"], row["twice"])
    packed = {r["segment"]: r["twice"] for b in whole.rows() for r in b.to_pylist()}
    found = bloom.Filter(packed, 8)
    assert found.hits(twice).all() and found.hits(once).mean() < 0.01


def test_poisson_counts_have_their_mean(spark):
    docs = spark.range(20_000).selectExpr(
        "id AS doc_id", "'abcd' AS text", "if(id % 4 = 0, 'small', 'large') AS source")
    got = Counter(r.source for r in mixing.mix_sources(docs).select("source").collect())
    assert all(abs(n - 10_000) < 4 * math.sqrt(10_000) for n in got.values())
    keys = [r.shuffle_key for r in mixing.mix_sources(docs).select("shuffle_key").collect()]
    assert keys == sorted(keys)
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"small": 3.0, "large": 1.0}).collect()}
    assert rates == pytest.approx({"small": 3.0, "large": 1 / 3})


def test_large_rates(spark):
    rates = {"zero": 0.0, "few": 2.5, None: 40.0, "many": 900.0, "huge": 1e6}
    frame = spark.createDataFrame(list(rates.items()), "source string, rate double")
    found = mixing.poisson_cdf(frame).collect()
    assert len(found) == 5
    for r in found:
        assert r.cdf[-1] == pytest.approx(1) and sorted(r.cdf) == r.cdf and len(r.cdf) < 30_000
        mean = r.first + sum(1 - x for x in r.cdf)
        assert mean == pytest.approx(rates[r.source], rel=1e-6, abs=1e-6)
        want, term = [], math.exp(-2.5)
        if r.source == "few":
            for k in range(12):
                want.append(term + (want[-1] if want else 0))
                term *= 2.5 / (k + 1)
            assert r.cdf[:12] == pytest.approx(want)


def test_a_row_of_very_many_copies(spark):
    rows = [(1, "a", "small"), (2, "a" * 300_000, "large")]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert abs(got[1] - 150_000) < 5 * math.sqrt(150_000)
    assert mixed.filter("doc_id = 1").select("copy").distinct().count() == got[1]
    largest = max(r.n for r in mixed.filter("doc_id = 1").select("copy").groupBy(
        F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert largest < got[1]


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_are_drawn_apart(spark, doc_id):
    rows = [(doc_id, f"text {i:04d}", "a") for i in range(2000)] + [(i, f"text {i:04d}", "b") for i in range(2000)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    copies = Counter(r.text for r in mixed.filter("source = 'a'").select("text").collect())
    assert abs(sum(copies.values()) - 2000) < 5 * math.sqrt(2000)
    assert set(Counter(copies.values())) >= {1, 2, 3} and len(copies) < 1500


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("a.bad.com", 0)] * 40 + [("b.bad.com", 1)] + [("c.bad.com", None)] + [("a.good.org", 1)] * 40 + [
        ("new.good.org", 0)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["a.bad.com"].upper < 0.5 < got["a.good.org"].good_share
    assert got["b.bad.com"].good_share < got["new.good.org"].good_share
    assert got["c.bad.com"].n == 0


def test_word_hashes_do_not_depend_on_place():
    found = word_spans(pa.array(["one two", None, "two\x0bone ", "", " one"]))
    by_word = defaultdict(set)
    for word, h in zip(["one", "two", "two", "one", "one"], found.hash, strict=True):
        by_word[word].add(int(h))
    assert all(len(x) == 1 for x in by_word.values()) and by_word["one"] != by_word["two"]
    assert found.text.tolist() == [0, 0, 2, 2, 4]


def test_pipeline_by_stages(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        after[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    kept = {r.doc_id: r.text for r in after["quality_rules"].collect()}
    judged = {r.doc_id: r.kept for r in Q["op7_quality_rules"](spark, sf_dir).collect()}
    assert kept == {d: t for d, t in texts.items() if judged[d]}

    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for d, t in kept.items():
        for x in t.split("\n"):
            holders[key(x)].add(d)
    lost = lambda x, d: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and d < max(holders[key(x)])
    cleaned = {d: "\n".join(x for x in t.split("\n") if not lost(x, d)) for d, t in kept.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after["line_dedup"].collect()} == {
        d: (t, len(t)) for d, t in cleaned.items()}

    single = {r.doc_id: r.text for r in after["near_duplicates"].collect()}
    sets = {d: shingle_counts(t) for d, t in cleaned.items()}
    assert set(single) <= set(cleaned) and all(cleaned[d] == t for d, t in single.items())
    for a, b in itertools.combinations(sorted(single), 2):
        if sets[a].keys() & sets[b].keys():
            assert jaccard(sets[a], sets[b]) < 0.8
    for d in set(cleaned) - set(single):
        assert any(sets[d].keys() & sets[x].keys() and jaccard(sets[d], sets[x]) >= 0.8 - 1e-9
                   for x in cleaned if x != d)

    mixed = Counter(r.doc_id for r in after["source_mixing"].collect())
    chars = Counter()
    source = {r.doc_id: r.source for r in after["near_duplicates"].collect()}
    for d, t in single.items():
        chars[source[d]] += len(t)
    for d in single:
        rate = sum(chars.values()) / len(chars) / chars[source[d]]
        u = int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) / 2**52
        n, upto, term = 0, math.exp(-rate), math.exp(-rate)
        while upto <= u:
            n += 1
            term *= rate / n
            upto += term
        assert mixed[d] == n

    pieces = Counter(r.doc_id for r in after["best_fit_packing"].filter("piece = 0").collect())
    assert pieces == mixed


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_no_text_is_cut_where_words_are_split_into_chunks():
    from eventide.llm.words import CHUNK_BYTES, chunks

    rows = ["x" * (CHUNK_BYTES + 5), "y", None, "z" * (CHUNK_BYTES // 2), "w" * CHUNK_BYTES]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])
    assert [x for part in chunks(batch) for x in part.column("text").to_pylist()] == rows


def test_line_keys():
    assert lines._key(" AbÉ\t".encode()) == "abÉ".encode()
    assert re.fullmatch(r"[a-z]+", "abc")
