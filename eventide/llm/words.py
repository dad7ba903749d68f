"""Words of a batch of texts as arrays: places and 64-bit hashes, worked out for all texts at once.

A word is a longest run of characters other than the six ASCII blanks. UTF-8 keeps those bytes to
themselves, so words are found on bytes, without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes worked on at once; one longer text is worked on alone.
CHUNK_BYTES = 1 << 20

BLANKS = b" \t\n\x0b\x0c\r"
_BLANK = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(BLANKS, np.uint8))
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_AS_IS >= 65) & (_AS_IS <= 90), _AS_IS + 32, _AS_IS).astype(np.uint8)

_LETTER = (_LOWER >= 97) & (_LOWER <= 122)
# Letters, digits, and all bytes of characters beyond ASCII.
LETTERS = _LETTER | ((_AS_IS >= 48) & (_AS_IS <= 57)) | (_AS_IS >= 128)

_PLACE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER_KEYS = _BYTE_KEYS[_LOWER]


def _span_hashes(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``keys[start:end]`` for each of the spans, which do not overlap and are in order.

    Equal sequences hash alike wherever they stand. A key counts by a number mixed from it and its
    place in the span, so that no power or difference of keys cancels another, as in a polynomial.
    """
    size = end - start
    opens = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(opens[-1])
    inner = keys[place + np.repeat(start - opens[:-1], size)]
    place -= np.repeat(opens[:-1], size)
    inner += place.view(np.uint64) * np.uint64(_PLACE)
    shifted = np.right_shift(inner, np.uint64(32))
    inner ^= shifted
    inner *= np.uint64(_SECOND)
    inner ^= np.right_shift(inner, np.uint64(29), out=shifted)
    sums = np.zeros(len(inner) + 1, np.uint64)
    np.cumsum(inner, out=sums[1:])
    return mix(sums[opens[1:]] - sums[opens[:-1]] + size.astype(np.uint64))


class Spans(NamedTuple):
    """Spans of a batch of texts, in order: the text's number, byte range, and hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, a null as empty, and where each text starts and the last ends."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``size`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if last > first:
            yield batch.slice(first, last - first)


def words(column: pa.Array, lower: bool = False, apart: bytes = b"", solid: np.ndarray = ~_BLANK) -> Spans:
    """Words of every text of the column; ``lower`` hashes A-Z as a-z.

    ``solid`` tells which bytes words are made of, by default all but blanks. A last byte that is one of ``apart`` becomes a word of its own if it follows an ASCII letter.
    """
    data, at = text_bytes(column)
    solid = solid[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    first, last = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
    opens[first], closes[last] = solid[first], solid[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if apart and len(start):
        alone = end - start < 2
        cut = np.isin(data[end - 1], np.frombuffer(apart, np.uint8)) & _LETTER[data[end - 2]] & ~alone
        of = np.repeat(np.arange(len(start)), 1 + cut)
        second = np.zeros(len(of), bool)
        second[1:] = of[1:] == of[:-1]
        start, end = np.where(second, end[of] - 1, start[of]), np.where(cut[of] & ~second, end[of] - 1, end[of])
    text = np.searchsorted(at, start, side="right") - 1
    keys = (_LOWER_KEYS if lower else _BYTE_KEYS)[data]
    return Spans(text, start, end, _span_hashes(keys, start, end))


def lines(column: pa.Array) -> Spans:
    """Lines of every text, at least one each, as their keys: trimmed of blanks, A-Z as a-z."""
    data, at = text_bytes(column)
    # A line ends before a \n and at the end of its text.
    ends = np.sort(np.concatenate([np.flatnonzero(data == 10), at[1:]]), kind="stable")
    text = _line_texts(data, at)
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    fresh = np.ones(len(ends), bool)
    fresh[1:] = text[1:] != text[:-1]
    starts[fresh] = at[text[fresh]]
    solid = np.flatnonzero(~_BLANK[data])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = hi > lo
    start, end = starts.copy(), starts.copy()
    start[some], end[some] = solid[lo[some]], solid[hi[some] - 1] + 1
    return Spans(text, start, end, _span_hashes(_LOWER_KEYS[data], start, end))


def _line_texts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(at, breaks, side="right") - 1
    count = np.bincount(of_break, minlength=len(at) - 1) + 1
    return np.repeat(np.arange(len(at) - 1), count)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ (b * np.uint64(_SECOND) + np.uint64(_PLACE)))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values, whatever texts they belong to.

    A run is the tree of its halves: runs of 1, 2, 4, ... values are joined two by two.
    """
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    power, width, found, covered = hashes, 1, None, 0
    while True:
        if size & width:
            part = power[covered:covered + n]
            found = part if found is None else _joined(found, part)
            covered += width
        if covered == size:
            return mix(found + np.uint64(size))
        power, width = _joined(power[:-width], power[width:]), 2 * width


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's longs."""
    return x.view(np.int64)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours."""
    least, width = values, 1
    while 2 * width <= size:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = size - width
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and where the last ends."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    fresh = np.ones(len(keys[0]) + 1, bool)
    fresh[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)
