"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Both token sequences of a text cover the same bytes. Places where tokens of both end cut them into
groups. They are found by divide and conquer: from the middle token of an interval outwards, a bisect
in the other sequence tells whether a token ends there as well; at the first common end the interval
is cut and both halves are worked on alike, and an interval without one is a group. All intervals of
a level, of all texts of a batch, are worked on at once.

How often a pair of ids ends together is counted over the whole corpus in blocks of texts: a block
asks for each of its distinct pairs once, pairs are added up and compared with the others of their
second id, of which there are at most as many as the first vocabulary has ids, and answers go back to
the blocks. No shuffle carries a row per token, and a very frequent pair is one row per block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.store import settle
from eventide.llm.words import chunks

# Bytes of text that are encoded at once, and that share one request for counts.
BATCH_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20


class Vocabulary(NamedTuple):
    """A tokenizer as a function of whole texts, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]


@lru_cache(maxsize=4)
def byte_level(file: str, pattern: str) -> Vocabulary:
    """Byte-level BPE of a file of ranks; a space is put before each text."""
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(lambda texts: [encoding.encode_ordinary(f" {t}") for t in texts], tokens)


@lru_cache(maxsize=4)
def pieces(file: str) -> Vocabulary:
    """A sentencepiece model, which puts a space before each text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    tokens = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
              for i, name in enumerate(names)]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), tokens)


class Tokenizers(NamedTuple):
    """Files of both tokenizers, and the pattern by which the first splits texts."""

    ranks: str
    pattern: str
    model: str

    def load(self) -> tuple[Vocabulary, Vocabulary]:
        return byte_level(self.ranks, self.pattern), pieces(self.model)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, closing_a: np.ndarray,
                closing_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a and of b, by index and in order, that end at the same byte.

    ``closing`` are the last tokens of texts, which end together; ends grow from text to text.
    """
    found_a, found_b = [closing_a], [closing_b]
    # Intervals of tokens that lie strictly between two cuts.
    low, high = np.concatenate([[0], closing_a[:-1] + 1]), closing_a
    while len(low):
        low, high = low[low < high], high[low < high]
        middle = (low + high) // 2
        cut, at = np.full(len(low), -1), np.zeros(len(low), np.int64)
        # Outwards from the middle: 0, 1, -1, 2, -2, ...
        rows, step = np.arange(len(low)), 0
        while len(rows):
            token = middle[rows] + step
            inside = (token >= low[rows]) & (token < high[rows])
            seen, token = rows[inside], token[inside]
            place = np.minimum(np.searchsorted(ends_b, ends_a[token]), len(ends_b) - 1)
            hit = ends_b[place] == ends_a[token]
            cut[seen[hit]], at[seen[hit]] = token[hit], place[hit]
            rows = rows[cut[rows] < 0]
            step = -step if step > 0 else 1 - step
            reach = np.maximum(high[rows] - 1 - middle[rows], middle[rows] - low[rows])
            rows = rows[abs(step) <= reach]
        some = cut >= 0
        found_a.append(cut[some])
        found_b.append(at[some])
        low, high = (np.concatenate([low[some], cut[some] + 1]), np.concatenate([cut[some], high[some]]))
    cuts_a, cuts_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(cuts_a)
    return cuts_a[order], cuts_b[order]


class Aligned(NamedTuple):
    """Tokens of a batch of texts, one after the other, and those that end together.

    ``first`` arrays hold where each text's tokens, or cuts, begin and the last ones end.
    """

    a: np.ndarray
    b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_cut: np.ndarray


def _encoded(texts: list[str | None], vocabularies: tuple[Vocabulary, Vocabulary]) -> list[list[list[int]]]:
    """Ids of both tokenizers for each text; none where either does not spell a space and the text."""
    known = [t or "" for t in texts]
    ids = [v.encode(known) for v in vocabularies]
    for i, text in enumerate(known):
        spelled = f" {text}".encode()
        if not text or any(b"".join(map(v.tokens.__getitem__, own[i])) != spelled
                           for v, own in zip(vocabularies, ids, strict=True)):
            for own in ids:
                own[i] = []
    return ids


def aligned(texts: list[str | None], tokenizers: Tokenizers) -> Aligned:
    """Both encodings of each text, cut where tokens end together."""
    vocabularies = tokenizers.load()
    ids = _encoded(texts, vocabularies)
    flat, first, ends = [], [], []
    for own, vocabulary in zip(ids, vocabularies, strict=True):
        first.append(np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)]))
        flat.append(np.fromiter((i for x in own for i in x), np.int32, first[-1][-1]))
        lengths = np.array([len(t) for t in vocabulary.tokens])
        ends.append(np.cumsum(lengths[flat[-1]]))
    some = np.flatnonzero(np.diff(first[0]))
    cuts = common_ends(*ends, *(x[some + 1] - 1 for x in first))
    return Aligned(*flat, *cuts, *first, np.searchsorted(cuts[0], first[0]))


@lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0, 1, ... padded with zero bytes, and how many there are."""
    digits = np.array([b"%d" % i for i in range(n)])
    return digits.view(np.uint8).reshape(n, -1), np.char.str_len(digits)


def group_texts(found: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: the ids of each group, in order."""
    n_a, n_b = len(found.a), len(found.b)
    if not n_a:
        return [b""] * (len(found.first_a) - 1)
    # A token of a stands after those of b in earlier groups, and the other way round.
    in_a, in_b = np.diff(found.cuts_a, prepend=-1), np.diff(found.cuts_b, prepend=-1)
    place_a = np.arange(n_a) + np.repeat(np.cumsum(in_b) - in_b, in_a)
    place_b = np.arange(n_b) + np.repeat(np.cumsum(in_a), in_b)
    ids, after = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    ids[place_a], ids[place_b] = found.a, found.b
    after[place_a[found.cuts_a]], after[place_b[found.cuts_b]] = ord("|"), ord(";")
    shown, length = _decimals(1 << int(ids.max()).bit_length())
    width = shown.shape[1]
    size = length[ids] + 1
    wide = np.zeros((len(ids), width + 1), np.uint8)
    wide[:, :width] = shown[ids]
    wide[np.arange(len(ids)), size - 1] = after
    text = wide[np.arange(width + 1) < size[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])
    bounds = ends[found.first_a + found.first_b]
    # Without the separator after the last group.
    return [text[x:y - 1] if y > x else b"" for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def aligned_tokens(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(doc_id, a, b, cuts_a, cuts_b) per row of ``docs``: ids, and how many of them lie before each cut.

    A null or empty text, or one that either tokenizer does not spell byte by byte after a space, has
    no ids and no cuts. Repeated rows are rows of their own; an empty table gives an empty result.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=BATCH_BYTES):
                found = aligned(part.column("text").to_pylist(), tokenizers)
                lists = [(found.a, found.first_a, None), (found.b, found.first_b, None),
                         (found.cuts_a, found.first_cut, found.first_a), (found.cuts_b, found.first_cut, found.first_b)]
                columns = []
                for values, first, of in lists:
                    if of is not None:
                        values = values + 1 - np.repeat(of[:-1], np.diff(first))
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], names=["doc_id", "a", "b", "cuts_a", "cuts_b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        align, f"doc_id {kind}, a array<int>, b array<int>, cuts_a array<int>, cuts_b array<int>")


_LISTS = "pairs array<long>, times array<int>"
_SUMMARY = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")


class _Block:
    """Rows of one block as they come: what each text links, by place among the block's pairs."""

    def __init__(self) -> None:
        self.bytes, self.rows, self.pairs, self.docs, self.n_docs = 0, [], [], [], 0

    def add(self, part: pa.RecordBatch, tokenizers: Tokenizers) -> None:
        found = aligned(part.column("text").to_pylist(), tokenizers)
        n_links = np.diff(found.first_cut)
        texts = group_texts(found)
        self.rows.append([
            part.column("doc_id"), pa.array(np.diff(found.first_a)), pa.array(np.diff(found.first_b)),
            pa.array(n_links), pa.array(n_links),
            pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts])])
        n_second = len(tokenizers.load()[1].tokens)
        self.pairs.append(found.a[found.cuts_a].astype(np.int64) * n_second + found.b[found.cuts_b])
        self.docs.append(np.repeat(np.arange(self.n_docs, self.n_docs + part.num_rows), n_links))
        self.n_docs += part.num_rows
        self.bytes += part.column("text").nbytes

    def batch(self, block: int) -> pa.RecordBatch:
        """One row per text; the first also has the block's own pairs and how often each occurs."""
        pairs, at, times = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        own, n = np.unique(np.concatenate(self.docs) * np.int64(max(len(pairs), 1)) + at, return_counts=True)
        doc, place = own // max(len(pairs), 1), own % max(len(pairs), 1)
        first = pa.array(np.searchsorted(doc, np.arange(self.n_docs + 1)).astype(np.int32))
        asked = pa.array(np.where(np.arange(self.n_docs + 1) > 0, len(pairs), 0).astype(np.int32))
        columns = [pa.concat_arrays([x if isinstance(x, pa.Array) else x.combine_chunks() for x in column])
                   for column in zip(*self.rows, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(self.n_docs, block)), *columns,
             pa.ListArray.from_arrays(first, pa.array(place.astype(np.int32))),
             pa.ListArray.from_arrays(first, pa.array(n.astype(np.int32))),
             pa.ListArray.from_arrays(asked, pa.array(pairs)),
             pa.ListArray.from_arrays(asked, pa.array(times.astype(np.int32)))],
            names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                   "links", "n", "pairs", "times"])


def _blocks(docs: DataFrame, tokenizers: Tokenizers, block_bytes: int) -> DataFrame:
    """Texts aligned, in blocks of neighbouring rows named after their first row."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = None, None
        for batch in batches:
            for part in chunks(batch, size=BATCH_BYTES):
                if block is None:
                    block, name = _Block(), part.column("row")[0].as_py()
                block.add(part, tokenizers)
                if block.bytes >= block_bytes:
                    yield block.batch(name)
                    block = None
        if block is not None:
            yield block.batch(name)

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(
        blocks, f"block long, {_SUMMARY}, links array<int>, n array<int>, {_LISTS}")


def pair_counts(asked: DataFrame, n_second: int) -> DataFrame:
    """(pair, count, best): links of each pair in the corpus, and whether none of its second id has more.

    ``asked`` has the pairs and times of blocks.
    """
    pairs = asked.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(
        F.sum("times").alias("count"))
    of_second = Window.partitionBy(F.col("pair") % n_second)
    return pairs.withColumn("best", F.col("count") == F.max("count").over(of_second))


_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def alignment_digests(docs: DataFrame, tokenizers: Tokenizers, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``.

    Texts without tokens, as `aligned_tokens` has it, have zeros and an empty groups_sha256. Repeated
    rows all count, and a very long text is a block of its own. An empty table gives an empty result.
    Only doc_id and text are read.
    """
    texts = settle(_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                           tokenizers, block_bytes))
    asked = texts.filter(F.size("pairs") > 0).select("block", "pairs", "times")
    counts = settle(pair_counts(asked, len(tokenizers.load()[1].tokens)))
    answers = asked.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair")).join(
        counts, "pair").select("of_block", "place", "count", "best")

    def sums(rows: pa.Table, found: pa.Table) -> pa.Table:
        links, n = (rows.column(c).combine_chunks() for c in ("links", "n"))
        order = np.argsort(found.column("place").to_numpy())
        count = found.column("count").to_numpy()[order]
        best = found.column("best").to_numpy(zero_copy_only=False)[order]
        doc = np.repeat(np.arange(rows.num_rows), links.value_lengths().to_numpy())
        at, times = (x.flatten().to_numpy() for x in (links, n))
        n_best, count_sum = np.zeros((2, rows.num_rows), np.int64)
        np.add.at(n_best, doc, times * best[at])
        np.add.at(count_sum, doc, times * count[at])
        kept = [rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*kept, n_best, count_sum, rows.column("groups_sha256")],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                               "groups_sha256"])

    own = texts.select("block", *[c.split()[0] for c in _SUMMARY.split(", ")], "links", "n")
    return own.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(sums, _RESULT)
