"""Line dedup: lines that many documents repeat stay only in the last document that holds them.

Two Bloom filters over all lines tell which may occur twice; only those are shuffled, as digests,
to be counted exactly. A line's key is the line without ASCII blanks at its ends, A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.bloom import SEGMENTS, Filter, seen_twice
from eventide.llm.store import settle
from eventide.llm.words import BLANKS, Spans, chunks, lines, text_bytes

MIN_CHARS, MIN_DOCS = 40, 5

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# A missing doc_id is one document, smaller than all others.
_UNNAMED = -(2**63)


def _key(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(_LOWER)


def _chars(key: bytes) -> int:
    return len(key.decode())


def _long_lines(batch: pa.RecordBatch, min_chars: int) -> tuple[Spans, np.ndarray]:
    """Lines of a batch, and which of them have keys of ``min_chars`` code points."""
    found = lines(batch.column("text"))
    data, _ = text_bytes(batch.column("text"))
    # Bytes that do not continue a character.
    count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return found, count[found.end] - count[found.start] >= min_chars


def _one_per_text(found: Spans, some: np.ndarray) -> np.ndarray:
    """Of the lines named, the first of each key in each text, by index."""
    at = np.flatnonzero(some)
    _, first = np.unique(np.stack([found.text[at].astype(np.uint64), found.hash[at]]), axis=1,
                         return_index=True)
    return at[np.sort(first)]


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                   segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, drop): digests of the keys that each document loses.

    Every document but the largest doc_id that holds a key of at least ``min_chars`` code points,
    found in at least ``min_docs`` documents, loses it.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(_UNNAMED)).alias("doc_id"), "text")

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch):
            found, some = _long_lines(part, min_chars)
            yield found.hash[_one_per_text(found, some)]

    suspected = Filter(seen_twice(texts, hashes, segments), segments)
    shared = docs.sparkSession.sparkContext.broadcast(suspected)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found, some = _long_lines(part, min_chars)
                some[some] = shared.value.hits(found.hash[some])
                at = np.flatnonzero(some)
                data = text_bytes(part.column("text"))[0].tobytes()
                digests = (hashlib.sha256(data[a:b].translate(_LOWER)).digest()
                           for a, b in zip(found.start[at], found.end[at], strict=True))
                # What is one line is told by the digest alone.
                own = list(dict.fromkeys(zip(found.text[at].tolist(), digests, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array([t for t, _ in own], pa.int64())),
                     pa.array([d for _, d in own], pa.binary())], names=["doc_id", "digest"])

    found = texts.mapInArrow(suspects, "doc_id long, digest binary")
    # Written, so that the join below starts from files and a hot digest of it can be split.
    frequent = settle(
        found.distinct().groupBy("digest")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        .filter(F.col("docs") >= min_docs).select("digest", "last"))
    return (
        found.join(frequent, "digest").filter(F.col("doc_id") < F.col("last"))
        .groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with the lines of `repeated_lines` taken out, one row per row.

    ``text`` holds the other lines, unchanged, joined by ``\\n``; a null text stays null and counts
    as one empty line. ``n_lines`` (before) and ``n_dropped`` are added. Rows that repeat a doc_id
    are parts of one document, and so are all rows without one, which comes before all others. An
    empty table gives an empty result. Other columns are kept as they are, but for two of the names
    added, which are replaced.
    """
    drops = repeated_lines(docs, min_chars, min_docs, segments)
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # One struct, so that no name of the input meets one of the join.
    own = docs.select(F.coalesce("doc_id", F.lit(_UNNAMED)).alias("doc_id"), F.struct(*others).alias("row"))
    schema = docs.select(*others).schema.add("n_lines", "long").add("n_dropped", "long")
    place = others.index("text")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(columns[place].to_pylist(), batch.column("drop").to_pylist(), strict=True):
                n = 1 if text is None else text.count("\n") + 1
                lost = 0
                if drop and text is not None:
                    drop = set(drop)
                    parts = text.encode().split(b"\n")
                    stay = [x for x in parts if _chars(key := _key(x)) < min_chars
                            or hashlib.sha256(key).digest() not in drop]
                    lost, text = n - len(stay), b"\n".join(stay).decode()
                texts.append(text)
                n_lines.append(n)
                n_dropped.append(lost)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*others, "n_lines", "n_dropped"])

    return own.join(drops, "doc_id", "left").select("row", "drop").mapInArrow(cleaned, schema)
