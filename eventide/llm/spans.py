"""Substring dedup: spans of many words that an earlier document already holds.

The token de Bruijn graph has a window of ``window`` words as an edge and the ``window - 1`` words
that neighbours share as a node. Edges that follow each other in a text and have the same least
``gram``-word hash, their minimizer, form one path; equal edges have equal minimizers, so a path can
only meet paths of its own minimizer. Three steps keep the rows few:

1. A Bloom filter of twice-seen minimizers, merged from all tasks, leaves out what is unique.
2. A minimizer that everywhere heads one and the same path is a nonbranching path: its edges need
   no row of their own, the path's first document decides for all of them.
3. Where paths branch, one occurrence of each distinct path is fetched by its coordinates, and its
   edges are compared one by one.

Paths and edges are told apart by two 64-bit hashes, the minimizer and their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.bloom import SEGMENTS, Filter, seen_twice
from eventide.llm.store import settle
from eventide.llm.words import chunks, grams, mix, runs, signed, sliding_min, words

WINDOW, GRAM = 50, 16

_PATH = ["minimizer", "path"]
_DOC = ["doc_id", "body"]


def _paths(batch: pa.RecordBatch, window: int, gram: int):
    """Paths of a batch: text number, first edge's place in the text, edges, minimizer."""
    found = words(batch.column("text"))
    edges = grams(found.hash, window)
    if not len(edges):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64), edges, edges
    inside = np.flatnonzero(found.text[:len(edges)] == found.text[window - 1:])
    least = sliding_min(grams(found.hash, gram), window - gram + 1)[inside]
    text, edges = found.text[inside], edges[inside]
    first_word = np.searchsorted(found.text, text)
    bounds = runs(text, least)
    at = bounds[:-1]
    return text[at], (inside - first_word)[at], bounds, edges, least[at]


def _path_rows(batch: pa.RecordBatch, window: int, gram: int, suspected: Filter) -> pa.RecordBatch:
    text, first, bounds, edges, minimizer = _paths(batch, window, gram)
    keep = suspected.hits(minimizer)
    size = np.diff(bounds)
    # One hash for the whole path, over its edges.
    sums = np.concatenate([[np.uint64(0)], np.cumsum(edges * _odd(len(edges), bounds))])
    path = sums[bounds[1:]] - sums[bounds[:-1]]
    wanted = np.repeat(keep, size)
    offsets = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
    of = pa.array(text[keep])
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(minimizer[keep])), pa.array(signed(path[keep])),
         batch.column("doc_id").take(of), batch.column("body").take(of),
         pa.array(first[keep].astype(np.int32)), pa.array(size[keep].astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(edges[wanted])))],
        names=[*_PATH, *_DOC, "first", "size", "edges"])


def _odd(n: int, bounds: np.ndarray) -> np.ndarray:
    """An odd factor for each place in its path, so that order counts."""
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    return (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)) | np.uint64(1)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                     segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, body, spans): word ranges covered by windows that a smaller doc_id holds as well.

    ``docs`` has doc_id, body and text; ``body`` tells apart the rows of one doc_id.
    """
    texts = docs.select(*_DOC, "text").filter(F.col("doc_id").isNotNull())

    def minimizers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch):
            text, _, _, _, minimizer = _paths(part, window, gram)
            once = np.unique(np.stack([text.astype(np.uint64), minimizer]), axis=1)
            yield once[1]

    suspected = docs.sparkSession.sparkContext.broadcast(
        Filter(seen_twice(texts, minimizers, segments), segments))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield _path_rows(part, window, gram, suspected.value)

    paths = settle(texts.mapInArrow(
        rows, "minimizer long, path long, doc_id long, body long, first int, size int, edges array<long>"))

    source = F.min(F.struct("doc_id", "body", "first"))
    distinct = settle(
        paths.groupBy(*_PATH).agg(source.alias("source"), F.max("doc_id").alias("last"))
        .select(*_PATH, "source.*", "last"))
    shared = distinct.groupBy("minimizer").agg(
        F.count("*").alias("paths"), F.min("doc_id").alias("first_doc"), F.max("last").alias("last_doc")
    ).filter(F.col("first_doc") < F.col("last_doc")).select("minimizer", "paths")
    compared = settle(distinct.join(shared, "minimizer"))
    spots = _early_edges(paths, compared.filter(F.col("paths") > 1), segments)

    # In every document after its first, all of a path is known from there; in the first itself,
    # those edges that other paths brought even earlier.
    def span(start, count):
        return F.struct(start.alias("start"), (start + count - 1 + window).alias("end"))

    placed = paths.select(*_PATH, *_DOC, "first", "size").join(
        compared.select(*_PATH, F.col("doc_id").alias("path_doc")), _PATH)
    whole = placed.filter(F.col("doc_id") > F.col("path_doc")).select(
        *_DOC, span(F.col("first"), F.col("size")).alias("span"))
    single = placed.filter(F.col("doc_id") == F.col("path_doc")).join(spots, _PATH).select(
        *_DOC, span(F.col("first") + F.col("place"), F.lit(1)).alias("span"))
    return whole.unionByName(single).groupBy(*_DOC).agg(F.collect_set("span").alias("spans"))


def _early_edges(paths: DataFrame, branching: DataFrame, segments: int) -> DataFrame:
    """(minimizer, path, place) of edges that another path has in an earlier document.

    One occurrence of each branching path is fetched, by its coordinates. Edges that no other path
    can have, by a filter over all of them, are left out.
    """
    fetched = settle(
        paths.select(*_PATH, *_DOC, "first", "edges")
        .join(branching.select(*_PATH, *_DOC, "first"), [*_PATH, *_DOC, "first"])
        .select(*_PATH, "doc_id", "edges"))

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The path's number and the hash of each edge, the minimizer mixed in."""
        edges = batch.column("edges")
        path = np.repeat(np.arange(len(edges)), np.diff(edges.offsets.to_numpy()))
        minimizer = batch.column("minimizer").to_numpy().view(np.uint64)
        return path, mix(edges.flatten().to_numpy().view(np.uint64) ^ minimizer[path])

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        path, own = of(batch)
        yield np.unique(np.stack([path.astype(np.uint64), own]), axis=1)[1]

    suspected = paths.sparkSession.sparkContext.broadcast(
        Filter(seen_twice(fetched, hashes, segments), segments))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, own = of(batch)
            keep = suspected.value.hits(own)
            place = np.arange(len(path)) - np.repeat(*_first_and_size(path)) if len(path) else path
            of_path = pa.array(path[keep])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(of_path) for c in (*_PATH, "doc_id")),
                 batch.column("edges").flatten().filter(pa.array(keep)),
                 pa.array(place[keep].astype(np.int32))], names=[*_PATH, "doc_id", "edge", "place"])

    edges = fetched.mapInArrow(rows, "minimizer long, path long, doc_id long, edge long, place int")
    # Written, so that the join below starts from files and a hot edge of it can be split.
    firsts = settle(
        edges.groupBy("minimizer", "edge").agg(F.min("doc_id").alias("edge_doc"), F.max("doc_id").alias("last"))
        .filter(F.col("edge_doc") < F.col("last")).drop("last"))
    return edges.join(firsts, ["minimizer", "edge"]).filter(F.col("edge_doc") < F.col("doc_id")).select(
        *_PATH, "place")


def _first_and_size(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = runs(path)
    return bounds[:-1], np.diff(bounds)


def _uncovered(n_words: int, spans: list[dict]) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    return np.cumsum(edge[:-1]) == 0


def drop_repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                        segments: int = SEGMENTS) -> DataFrame:
    """``docs`` without the words of windows that also start in a document with a smaller doc_id.

    ``text`` holds the words that stay, joined by single spaces (null stays null); ``n_words``
    (before) and ``n_removed`` are added. Windows are judged on the input, all at once. Texts of
    fewer than ``window`` words, empty ones included, lose nothing. Rows that share a doc_id do not
    make each other lose words, and rows without a doc_id are neither changed nor counted. An empty
    table gives an empty result. Other columns are kept, but for two of the names added.
    """
    others = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    # One struct, so that no name of the input meets one of the join.
    own = docs.select("doc_id", F.xxhash64("text").alias("body"), F.struct(*others).alias("row"))
    found = repeated_windows(own.select(*_DOC, "row.text"), window, gram, segments)
    joined = own.join(found, _DOC, "left").select("row", "spans")
    schema = docs.select(*others).schema.add("n_words", "long").add("n_removed", "long")
    place = others.index("text")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            texts, n_words, n_removed = [], [], []
            for text, spans in zip(columns[place].to_pylist(), batch.column("spans").to_pylist(),
                                   strict=True):
                parts = (text or "").encode().split()
                n_words.append(len(parts))
                if spans:
                    stay = _uncovered(len(parts), spans)
                    parts = [parts[i] for i in np.flatnonzero(stay)]
                n_removed.append(n_words[-1] - len(parts))
                texts.append(None if text is None else b" ".join(parts).decode())
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=[*others, "n_words", "n_removed"])

    return joined.mapInArrow(cleaned, schema)
