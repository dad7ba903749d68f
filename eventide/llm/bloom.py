"""Bloom filters of fixed size for once-seen and twice-seen hashes, built by all tasks together.

A filter is cut into segments; all bits of a hash lie in one. Two filters merge segment by segment:
once-seen bits are joined, and whatever is set in both has been seen at least twice. The merged
twice-seen filter misses no repeated hash, and lets a few others pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventide.llm.words import mix

SEGMENT_BYTES = 1 << 16
PROBES = 3
# 32 MB of bits for all segments: the most that is ever held by a task or sent to the driver.
SEGMENTS = 512

_SCHEMA = "segment int, once binary, twice binary"


def _places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, byte in it and bit of each probe of each hash; segments are a power of two."""
    own = mix(hashes + np.uint64(0x2545F4914F6CDD1D))
    segment = (own & np.uint64(segments - 1)).astype(np.int64)
    steps = mix(own)[:, None] >> np.array([19 * i for i in range(PROBES)], np.uint64)
    bit = (steps & np.uint64(SEGMENT_BYTES * 8 - 1)).astype(np.int64)
    return segment, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8)


class SeenTwice:
    """What one task has seen, as two filters whose segments are made when they are needed."""

    def __init__(self, segments: int = SEGMENTS) -> None:
        self.segments = segments
        self.once: dict[int, np.ndarray] = {}
        self.twice: dict[int, np.ndarray] = {}

    def _of(self, segment: int) -> tuple[np.ndarray, np.ndarray]:
        if segment not in self.once:
            self.once[segment] = np.zeros(SEGMENT_BYTES, np.uint8)
            self.twice[segment] = np.zeros(SEGMENT_BYTES, np.uint8)
        return self.once[segment], self.twice[segment]

    def add(self, hashes: np.ndarray) -> None:
        """Count each of these sightings; equal hashes are several sightings."""
        hashes, count = np.unique(hashes, return_counts=True)
        segment, byte, mask = _places(hashes, self.segments)
        order = np.argsort(segment, kind="stable")
        cuts = np.flatnonzero(np.diff(segment[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            once, twice = self._of(int(segment[rows[0]]))
            at, bit = byte[rows], mask[rows]
            again = ((once[at] & bit) != 0).all(axis=1) | (count[rows] > 1)
            np.bitwise_or.at(twice, at[again], bit[again])
            np.bitwise_or.at(once, at, bit)

    def merge(self, segment: int, once: bytes, twice: bytes) -> None:
        own_once, own_twice = self._of(segment)
        other = np.frombuffer(zlib.decompress(once), np.uint8)
        own_twice |= np.frombuffer(zlib.decompress(twice), np.uint8) | (own_once & other)
        own_once |= other

    def rows(self) -> Iterator[pa.RecordBatch]:
        for segment in sorted(self.once):
            once, twice = (zlib.compress(x[segment].tobytes(), 1) for x in (self.once, self.twice))
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([once]), pa.array([twice])],
                names=["segment", "once", "twice"])


def seen_twice(df: DataFrame, hashes_of, segments: int = SEGMENTS) -> dict[int, bytes]:
    """Twice-seen filter of ``hashes_of(batch)`` over all batches of ``df``.

    Tasks send filters, not rows: at most ``segments`` segments each, compressed, dealt out by
    segment and merged one by one. What reaches the driver is at most ``segments`` times 64 KB.
    """

    def sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice(segments)
        for batch in batches:
            for hashes in hashes_of(batch):
                seen.add(hashes)
        yield from seen.rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice(segments)
        for batch in batches:
            for row in batch.to_pylist():
                seen.merge(row["segment"], row["once"], row["twice"])
        yield from seen.rows()

    rows = df.mapInArrow(sightings, _SCHEMA).repartition("segment").mapInArrow(merged, _SCHEMA)
    return {r.segment: bytes(r.twice) for r in rows.select("segment", "twice").toLocalIterator()}


class Filter:
    """A merged filter, unpacked once per process."""

    def __init__(self, packed: dict[int, bytes], segments: int = SEGMENTS) -> None:
        self.packed, self.segments = packed, segments
        self._bits: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "segments": self.segments, "_bits": {}}

    def __contains__(self, segment: int) -> bool:
        return segment in self.packed

    def _of(self, segment: int) -> np.ndarray:
        if segment not in self._bits:
            self._bits[segment] = np.frombuffer(zlib.decompress(self.packed[segment]), np.uint8)
        return self._bits[segment]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may have been seen twice; every one that was, is among them."""
        segment, byte, mask = _places(hashes, self.segments)
        found = np.zeros(len(hashes), bool)
        order = np.argsort(segment, kind="stable")
        cuts = np.flatnonzero(np.diff(segment[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            if int(segment[rows[0]]) in self:
                bits = self._of(int(segment[rows[0]]))
                found[rows] = ((bits[byte[rows]] & mask[rows]) != 0).all(axis=1)
        return found
