"""Packing documents into token sequences by vector best-fit.

Every sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece
lengths). Pieces are placed longest first, each into the open sequence that has room for it in all
three and fits best: by the norm of what it leaves free, or by the dot product of what it needs and
what is free, both weighted.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from eventide.llm.store import settle
from eventide.llm.words import chunks, text_bytes, words

# Pieces packed together. Within a group waste comes to about one sequence, whatever its size.
GROUP = 8192
# Words whose ids a worker remembers.
REMEMBERED = 2_000_000
# Bytes of text whose words are looked up together: each distinct one once.
LOOK_UP_BYTES = 3 << 20
# New words encoded together.
TOGETHER = 1000


class Capacity(NamedTuple):
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


# What a unit of each capacity counts for; tokens are what sequences run out of.
WEIGHTS = (1.0, 0.01, 0.01)

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids:
    """Token ids of texts, as little-endian bytes, by way of a memory of words.

    No token crosses a blank, and the tokenizer drops white space, so a text's ids are those of its
    words, one after the other; and where the tokenizer parts letters from a mark that follows them, so
    is the mark looked up alone. Words are looked up by their 64-bit hashes, for all texts of a chunk
    at once. New ones are encoded many at a time. Words of letters alone come out as one piece each, whose last token alone ends a
    word, where the vocabulary marks word ends; other parts are set apart by a special token, which
    no token crosses either.
    """

    def __init__(self, tokenizer: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(tokenizer)
        # Whether A-Z are taken as a-z, and which marks are never part of a word's letters.
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.folds = normalizer is not None and normalizer.normalize_str(capitals) == capitals.lower()
        self.apart = b"".join(
            mark.encode() for mark in ".,;:!?" if splitter is not None
            and [x for x, _ in splitter.pre_tokenize_str("ab" + mark)] == ["ab", mark])
        # Number of each word's hash; where its ids are in the pool.
        self.index: dict[int, int] = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")
        self.count = self.used = 0
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = tuple(special)
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1], default=(None, None))
        ending = json.loads(tokenizer)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if ending and t.endswith(ending)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _words(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of words of letters."""
        found = {}
        for at in range(0, len(parts), TOGETHER):
            some = parts[at:at + TOGETHER]
            ids = self._ids(" ".join(some))
            cuts = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(cuts) != len(some):
                found.update(self._parts(some))
                continue
            whole = ids.tobytes()
            found.update(zip(some, map(whole.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        return found

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        found = {}
        plain = [p for p in parts if self.mark and not any(s in p for s in self.special)]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at:at + TOGETHER]
            ids = self._ids(self.mark.join(some))
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            whole = ids.tobytes()
            found.update(
                (part, whole[4 * a + 4:4 * b])
                for part, a, b in zip(some, [-1, *cuts], [*cuts, len(ids)], strict=True))
        for part in set(parts).difference(found):
            found[part] = self._ids(part).tobytes()
        return found

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        letters, others = [], []
        for part in parts:
            # Some capitals are more than letters in lower case.
            (letters if part.isalpha() and (part.isascii() or part.lower().isalpha()) else others).append(part)
        return self._words(letters) | self._parts(others)

    def of(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, ``end_id`` after each, and where each text's ids begin."""
        found = words(column, self.folds, self.apart)
        own, first, at = np.unique(found.hash, return_index=True, return_inverse=True)
        names = own.tolist()
        number = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        before = len(self.index), self.used
        if len(new):
            data = text_bytes(column)[0].tobytes()
            spans = zip(found.start[first[new]].tolist(), found.end[first[new]].tolist(), strict=True)
            parts = [data[a:b].decode() for a, b in spans]
            number[new] = self._remember([names[i] for i in new.tolist()], parts)
        length, start = self.length[number][at], self.start[number][at]
        per_text = np.bincount(found.text, length, len(column)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
        ids = np.full(bounds[-1], end_id, "<u4")
        # Each word's ids, moved on by the ends of the texts before its own.
        to = np.cumsum(length) - length + found.text
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        ids[np.repeat(to, length) + step] = self.pool[np.repeat(start, length) + step]
        if len(self.index) > REMEMBERED:
            for i in new.tolist():
                del self.index[names[i]]
            self.used = before[1]
            self.count = before[0]
        return ids, bounds

    def _remember(self, names: list[int], parts: list[str]) -> np.ndarray:
        """Take in new words; their numbers."""
        encoded = self._new(parts)
        ids = [encoded[part] for part in parts]
        size = np.array([len(x) // 4 for x in ids])
        more = np.frombuffer(b"".join(ids), "<u4")
        number = np.arange(self.count, self.count + len(parts))
        self.count += len(parts)
        self.pool = _room(self.pool, self.used + len(more))
        self.start, self.length = (_room(x, self.count) for x in (self.start, self.length))
        self.pool[self.used:self.used + len(more)] = more
        self.start[number], self.length[number] = self.used + np.cumsum(size) - size, size
        self.used += len(more)
        self.index.update(zip(names, number.tolist(), strict=True))
        return number


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, with space for at least ``size`` entries."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


_WORKER: dict[int, _Ids] = {}


def cut_pieces(docs: DataFrame, tokenizer_file: str, tokens: int = 2048, end_id: int = 0,
               with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``tokens`` ids: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is its text's ids, then ``end_id``; a null or empty text is ``end_id`` alone. Only
    longer documents are cut, and only their last piece may be shorter. ``ids`` holds the piece as
    little-endian unsigned 32-bit integers.
    """
    with open(tokenizer_file, "rb") as file:
        content = file.read()
    vocabulary, name = docs.sparkSession.sparkContext.broadcast(content), zlib.crc32(content)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _WORKER:
            _WORKER[name] = _Ids(vocabulary.value)
        ids = _WORKER[name]
        for batch in batches:
            for part in chunks(batch, size=LOOK_UP_BYTES):
                found, bounds = ids.of(part.column("text"), end_id)
                whole = found.tobytes()
                rows = [
                    (doc_id, at // tokens, at, len(piece) // 4, zlib.crc32(piece),
                     *([piece] if with_ids else []))
                    for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(),
                                            bounds[1:].tolist(), strict=True)
                    for at in range(0, b - a, tokens)
                    for piece in [whole[4 * (a + at):4 * min(a + at + tokens, b)]]
                ]
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=False)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return docs.select("doc_id", "text").mapInArrow(pieces, _PIECE + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity(), weights=WEIGHTS,
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. ``rule`` is ``norm`` or ``dot``."""
    limit = np.array(capacity, float)
    weight = np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free = np.empty((3, len(lengths) + 1))
    names = np.empty(len(lengths) + 1, np.int64)
    n_open = made = 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (need > limit).any():
            raise ValueError(f"a piece of {lengths[i]} tokens fits no sequence")
        best = -1
        if n_open:
            left = free[:, :n_open] - need[:, None]
            fits = np.flatnonzero((left >= 0).all(axis=0))
            if len(fits):
                share = left[:, fits] / limit[:, None]
                if rule == "norm":
                    best = fits[np.argmin(weight @ (share * share))]
                else:
                    best = fits[np.argmax((weight * need / limit) @ (free[:, fits] / limit[:, None]))]
        if best < 0:
            best, n_open = n_open, n_open + 1
            free[:, best], names[best], made = limit, made, made + 1
        sequence[i], offset[i] = names[best], limit[0] - free[0, best]
        free[:, best] -= need
        if free[:2, best].min() < 1 or free[2, best] < 1:  # full: the last open one takes its place
            n_open -= 1
            free[:, best], names[best] = free[:, n_open], names[n_open]
    return sequence, offset


def place_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), weights=WEIGHTS,
                 rule: str = "norm", group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are dealt out evenly and packed in groups of ``group``: as many groups as the input
    needs, each bounded, in an order that a repeated task finds again.
    """
    rows = pieces.count()
    order = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in pieces.columns]
    dealt = pieces.repartition(max(1, -(-rows // group))).sortWithinPartitions(*order)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def packed(table: pa.Table, base: int) -> Iterator[pa.RecordBatch]:
        sequence, offset = best_fit(table.column("length").to_numpy(), capacity, weights, rule)
        table = table.append_column("sequence_id", pa.array(sequence + base))
        yield from table.append_column("offset", pa.array(offset)).to_batches()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, waiting, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, 2 * group - n)
                waiting.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == 2 * group:
                    yield from packed(pa.Table.from_batches(waiting), base)
                    base, waiting, n = base + n, [], 0
        if waiting:
            yield from packed(pa.Table.from_batches(waiting), base)

    return dealt.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(),
                   end_id: int = 0, weights=WEIGHTS, rule: str = "norm",
                   with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    See `cut_pieces` for what a document is. Each row is a document of its own, also where a doc_id
    repeats or is missing; equal rows differ by their place alone. An empty table gives an empty
    result; other columns are not read.
    """
    pieces = settle(cut_pieces(docs, tokenizer_file, capacity.tokens, end_id, with_ids))
    return place_pieces(pieces, capacity, weights, rule)
