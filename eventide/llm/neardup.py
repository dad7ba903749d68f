"""Near-duplicates by ProbMinHash: signatures of weighted shingles, banding, verification, classes.

A text is its five-word shingles, each with the weight 1 + ln(count). A shingle is the source of a
Poisson process of arrivals, its weight the rate, each arrival at a random component of the
signature; a component keeps whoever arrives first, and a shingle is done with as soon as its next
arrival comes later than everything kept. Two texts agree in a component with the probability
Jaccard similarity of their weighted shingles, which is the Jaccard similarity where nothing repeats.

Texts that agree in all components of a band share a bucket; exact copies are one node. Candidates
are verified by the Jaccard similarity of their shingle sets, which repeats do not change, so a text
that repeats shingles has the bands of equal weights as well: where nothing repeats both are the same. Buckets are not spelled out into
pairs: first everyone is compared with the bucket's first member, its center; and if a bucket still
holds several classes, its members are compared in blocks by how they differ from the center.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.components import components
from eventide.llm.store import settle
from eventide.llm.words import Spans, chunks, grams, mix, runs, signed, words

SHINGLE = 5
SIMILARITY = 0.8
# At similarity 0.8 all bands of equal weights miss with probability (1 - 0.8**5)**28, 1 in 70,000.
BANDS, ROWS = 28, 5

# Members of a bucket, and shingles in which they differ from its center, that a block holds.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(found: Spans, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle; a shorter text is one shingle."""
    whole = grams(found.hash, size)
    inside = found.text[:len(whole)] == found.text[size - 1:] if len(whole) else np.empty(0, bool)
    text, own = found.text[:len(whole)][inside], whole[inside]
    bounds = runs(found.text)
    short = np.flatnonzero(np.diff(bounds) < size)
    rest = np.array([_sequence(found.hash[bounds[i]:bounds[i + 1]]) for i in short], np.uint64)
    text = np.concatenate([text, found.text[bounds[short]]])
    own = np.concatenate([own, rest])
    order = np.lexsort((own, text))
    text, own = text[order], own[order]
    at = runs(text, own)
    return text[at[:-1]], own[at[:-1]], np.diff(at)


def _sequence(hashes: np.ndarray) -> np.uint64:
    return grams(hashes, len(hashes))[0]


def prob_min_hash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int,
                  components_: int) -> np.ndarray:
    """Signature of each text as the elements that arrived first; texts without elements get 0.

    Round by round every element still in the race draws its next arrival. The draws depend on the
    element and the round alone, so that an element does the same in every text.
    """
    first = np.full(n_texts * components_, np.inf)
    winner = np.zeros(n_texts * components_, np.uint64)
    last = np.full(n_texts, np.inf)
    time, rate = np.zeros(len(element)), weight.astype(float)
    draw = 0
    while len(element):
        draw += 1
        random = mix(element + np.uint64(draw * int(_GOLDEN) % 2**64))
        uniform = (random >> np.uint64(11)).astype(float) * 2.0**-53
        time = time - np.log1p(-uniform) / rate
        spot = text * components_ + (mix(random ^ _GOLDEN) % np.uint64(components_)).astype(np.int64)
        np.minimum.at(first, spot, time)
        won = first[spot] == time
        winner[spot[won]] = element[won]
        racing = np.unique(text)
        last[racing] = first.reshape(n_texts, components_)[racing].max(axis=1)
        alive = time < last[text]
        text, element, time, rate = text[alive], element[alive], time[alive], rate[alive]
    return winner.reshape(n_texts, components_)


def _bands(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    found = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), (len(signatures), 1))
    parts = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        found = mix(found * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return found


def _with_equal_weights(weighted: np.ndarray, text: np.ndarray, element: np.ndarray, count: np.ndarray,
                        bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bands of each text, one after the other, and how many it has.

    Texts in which something repeats have those of equal weights beside the ``weighted`` ones.
    """
    repeats = np.unique(text[count > 1])
    own = np.isin(text, repeats)
    equal = prob_min_hash(np.searchsorted(repeats, text[own]), element[own], np.ones(own.sum()),
                          len(repeats), bands * rows)
    both = np.tile(weighted, 2)
    both[repeats, bands:] = _bands(equal, bands, rows)
    there = np.ones(both.shape, bool)
    there[:, bands:] = np.isin(np.arange(len(both)), repeats)[:, None]
    return both[there], there.sum(axis=1)


def _signed_texts(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, body, body2, bands) of texts with words; equal word sequences have equal bodies."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = words(part.column("text"))
                text, own, count = shingles(found)
                if not len(text):
                    continue
                some = np.unique(text)
                number = np.searchsorted(some, text)
                signature = prob_min_hash(number, own, 1 + np.log(count), len(some), bands * rows)
                spread, sizes = _with_equal_weights(
                    _bands(signature, bands, rows), number, own, count, bands, rows)
                bounds = runs(found.text)
                body = np.array([_sequence(found.hash[a:b]) for a, b in
                                 zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
                body2 = np.add.reduceat(mix(own + _GOLDEN) * count.astype(np.uint64), runs(text)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(some)), pa.array(signed(body)),
                     pa.array(signed(body2)),
                     pa.ListArray.from_arrays(
                         pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                         pa.array(signed(spread)))],
                    names=["doc_id", "body", "body2", "bands"])

    return docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).mapInArrow(
        sign, "doc_id long, body long, body2 long, bands array<long>")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sets share, each in ascending order."""
    return len(np.intersect1d(a, b, assume_unique=True))


def _both_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, "text_a", "text_b")


def _shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both shingle sets of each row, worked out for many rows at once."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        text, own, _ = shingles(words(column))
        bounds = np.searchsorted(text, np.arange(len(column) + 1))
        return [own[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    for part in chunks(batch, "text_a"):
        # Rows of one center come together; its text is read once.
        name = part.column("b").to_numpy()
        long = pc.binary_length(part.column("text_b")).to_numpy()
        first = runs(name, long)
        own = sets(part.column("text_a"))
        other = sets(part.column("text_b").take(pa.array(first[:-1])))
        again = (x for x, n in zip(other, np.diff(first), strict=True) for _ in range(n))
        yield from zip(own, again, strict=True)


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, common) of each pair (a, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(a), len(b), overlap(a, b)) for a, b in _shingle_sets(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"),
                 *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))],
                names=["a", "b", "size_a", "size_b", "common"])

    return _both_texts(pairs, texts).mapInArrow(
        compare, "a long, b long, size_a long, size_b long, common long")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one class, with their class."""
    own = members.join(labels, "node", "left").select(
        "band", "center", "node", F.coalesce("label", "node").alias("label"))
    several = own.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return own.join(several.filter(F.col("low") < F.col("high")).select("band", "low"), "band")


def _links_left(opened: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of a bucket that are in two classes, the bucket's center apart.

    A and B differ in as many shingles as their differences from the center do, so the differences
    are all that is needed: |A ^ B| = |A ^ c| + |B ^ c| - 2 |(A ^ c) & (B ^ c)|. The members around
    one center are dealt into blocks of bounded size, and each two blocks are compared at once, by
    counting shared differences; only links become rows.
    """
    around = opened.select("center", "node", "label").distinct()
    others = around.filter(F.col("node") != F.col("center"))
    several = others.groupBy("center").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(
        F.col("low") < F.col("high")).select("center")
    pairs = others.join(several, "center").select(
        F.col("node").alias("a"), F.col("center").alias("b"), "label")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found = [], []
            for a, b in _shingle_sets(batch):
                size.append(len(a))
                found.append(signed(np.setxor1d(a, b, assume_unique=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("b"), batch.column("a"), batch.column("label"), pa.array(size, pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))],
                names=["center", "node", "label", "size", "differences"])

    apart = settle(_both_texts(pairs, texts).mapInArrow(
        differences, "center long, node long, label long, size long, differences array<long>"))
    blocks = apart.groupBy("center").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS),
        F.ceil(F.sum(F.size("differences")) / BLOCK_SHINGLES)).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = apart.join(blocks, "center").withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def meet(table: pa.Table) -> pa.Table:
        node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
        size = table.column("size").to_numpy()
        lists = table.column("differences").combine_chunks()
        many = np.diff(lists.offsets.to_numpy())
        _, at, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(node)), many)[count[at] > 1]
        column = np.unique(at[count[at] > 1], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(node), len(node)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
            a, b = np.searchsorted(column, [first, first + 1024])
            part = np.zeros((len(node), 1024), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            shared += part @ part.T
        differ = many[:, None] + many[None, :] - 2 * shared
        total = size[:, None] + size[None, :]
        common = (total - differ) / 2
        linked = (common >= similarity * (total - common) - 1e-3) & (label[:, None] != label[None, :])
        linked &= node[:, None] < node[None, :]
        if (block != block[0]).any():
            linked &= block[:, None] != block[None, :]
        x, y = np.nonzero(linked)
        return pa.table([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    return met.repartition("center", "i", "j").groupBy("center", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS,
                 rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, kept), one row per row of ``docs``.

    Texts whose Jaccard similarity over word five-grams is at least ``similarity`` are linked; a
    class is what links connect, named by its smallest doc_id, which is kept. Texts of fewer than
    five words are one shingle. Texts without words, null ones included, are classes of their own.
    Rows that share a doc_id are one document and one class; rows without a doc_id are kept, with no
    class. An empty table gives an empty result. Only doc_id and text are read.
    """
    signed_texts = settle(_signed_texts(docs, bands, rows))
    bodies = ["body", "body2"]
    nodes = settle(signed_texts.groupBy(*bodies).agg(F.min("doc_id").alias("node")))
    spread = (
        signed_texts.join(nodes, [*bodies])
        .filter(F.col("doc_id") == F.col("node"))
        .select("node", F.explode("bands").alias("band")).distinct()
    )
    buckets = spread.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("n"))
    members = settle(spread.join(buckets.filter(F.col("n") > 1).drop("n"), "band"))
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = settle(docs.select("doc_id", "text").filter(F.col("text").isNotNull())
                   .join(wanted, "doc_id", "left_semi"))

    links = F.col("common") >= similarity * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9
    pairs = members.filter(F.col("node") != F.col("center")).select(
        F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    labels = settle(components(settle(_compare(pairs, texts)).filter(links)))

    # What is left between classes.
    last = _links_left(_open_buckets(members, labels), texts, similarity)

    # Rows of one doc_id belong together, whatever their texts.
    own = signed_texts.join(nodes, [*bodies]).select("doc_id", "node")
    one = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    found = last.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))).unionByName(
        one.filter(F.col("a") < F.col("b")).select("a", "b")).unionByName(
        own.join(one, "doc_id").filter((F.col("node") > F.col("a")) & (F.col("node") < F.col("b")))
        .select("a", F.col("node").alias("b")))
    classes = components(found)
    known = one.select("doc_id", F.col("a").alias("node")).join(classes, "node", "left").select(
        F.col("doc_id").alias("of"), F.coalesce("label", "node").alias("class_id"))
    return docs.select("doc_id").join(known, F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def first_of_each_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` without near-duplicates of an earlier document, see `near_classes`.

    Of rows that share a doc_id one stays.
    """
    later = near_classes(docs, similarity).filter(~F.col("kept")).select("doc_id").distinct()
    repeated = settle(docs.groupBy("doc_id").count().filter(
        (F.col("count") > 1) & F.col("doc_id").isNotNull()).select("doc_id"))
    kept = docs.join(later.unionByName(repeated), "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    one = docs.join(repeated, "doc_id", "left_semi").join(later, "doc_id", "left_anti")
    return kept.unionByName(one.dropDuplicates(["doc_id"])).select(*docs.columns)
