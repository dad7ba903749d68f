"""License scans: matching statistics against a suffix automaton, chained into covered spans.

All templates are read into one generalised suffix automaton of their words, so its size is bounded
by theirs. A file streams through it once: at each word the automaton knows the longest run of words,
ending here, that stands in some template. Runs that no next word lengthens and that are long enough
are placed in every template that has them, and those in the same order in file and template, with
small gaps, are chained. A chain that covers enough of its template is a span of that license.

Files stay where they are: there is no shuffle, and what is sent to the tasks is the automaton.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.license_texts import LICENSE_TEXTS
from eventide.llm.words import LETTERS, Spans, chunks, words

# Phrases that name a license, and its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Words of a match, words that may be skipped between two of a chain, and the least share of its
# template that a chain has to cover.
MIN_MATCH, MAX_GAP, MIN_SHARE = 3, 12, 0.75


class Span(NamedTuple):
    """Words ``first`` to ``last`` of a file, which cover ``covered`` of a template's words."""

    template: int
    first: int
    last: int
    covered: int


class Match(NamedTuple):
    """``size`` words, the last of them ``end`` in the file and ``place`` in the template."""

    end: int
    place: int
    size: int


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """Generalised suffix automaton of sequences of small integers."""

    def __init__(self, sequences: Sequence[Sequence[int]], min_match: int = MIN_MATCH) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                while len(own) < len(self.next):
                    own.append([])
                own[last].append((number, place))
        # Where the runs of a state end: in the state itself and in all that lengthen it to the left.
        self.ends: list[list[tuple[int, int]]] = [list(x) for x in own]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= min_match:
                self.ends[self.link[state]] += self.ends[state]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _extend(self, last: int, symbol: int) -> int:
        """The state of everything read of this sequence and ``symbol``."""
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = state
            last = self.link[last]
        if last >= 0:
            known = self.next[last][symbol]
            shorter = self.length[known] == self.length[last] + 1
            self.link[state] = known if shorter else self._split(last, symbol, known)
        return state

    def _split(self, last: int, symbol: int, known: int) -> int:
        """A state of its own for those runs of ``known`` that ``last`` and ``symbol`` spell."""
        state = self._new(self.length[last] + 1, self.link[known], dict(self.next[known]))
        self.link[known] = state
        while last >= 0 and self.next[last].get(symbol) == known:
            self.next[last][symbol] = state
            last = self.link[last]
        return state

    def statistics(self, symbols: Sequence[int]) -> Iterator[tuple[int, int]]:
        """At each symbol the state and length of the longest run, ending there, of some sequence."""
        state, size = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(symbol, 0)
            size = size + 1 if state else 0
            yield state, size


class Scanner:
    """Templates as an automaton of word numbers; words are known by their hashes."""

    def __init__(self, templates: Sequence[tuple[str, str]], min_match: int = MIN_MATCH) -> None:
        texts = [template_words(text) for _, text in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(t) for t in texts]
        phrases = [phrase.split() for phrase, _ in PHRASES]
        self.names = sorted({w for t in [*texts, *phrases] for w in t})
        hashes = words(pa.array(self.names), solid=LETTERS).hash
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        number = {w: i for i, w in enumerate(self.names)}
        self.phrases = [np.array([number[w] for w in p]) for p in phrases]
        self.min_match = min_match
        self.automaton = Automaton([[number[w] for w in t] for t in texts], min_match)

    def numbered(self, column: pa.Array) -> tuple[Spans, np.ndarray]:
        """Words of texts, and the number of each, or -1."""
        found = words(column, lower=True, solid=LETTERS)
        at = np.minimum(np.searchsorted(self.hashes, found.hash), len(self.hashes) - 1)
        return found, np.where(self.hashes[at] == found.hash, self.numbers[at], -1)

    def matches(self, found: Spans, number: np.ndarray) -> Iterator[tuple[int, dict[int, list[Match]]]]:
        """Matches of each text that has any, by template and in order; words count from its first."""
        known = number >= 0
        # Only runs of known words, inside one text, can match.
        fresh = np.ones(len(number) + 1, bool)
        fresh[1:-1] = ~known[1:] | ~known[:-1] | (found.text[1:] != found.text[:-1])
        bounds = np.flatnonzero(fresh)
        long = np.flatnonzero(np.diff(bounds) >= self.min_match)
        text, of_text = -1, {}
        for run in long:
            a, b = bounds[run], bounds[run + 1]
            if found.text[a] != text:
                if of_text:
                    yield text, of_text
                text, of_text = int(found.text[a]), defaultdict(list)
                base = int(np.searchsorted(found.text, text))
            before, at = (0, 0), int(a) - base - 1
            # A last symbol that is in no template ends the last run.
            for state, size in self.automaton.statistics([*number[a:b].tolist(), -1]):
                if size <= before[1] and before[1] >= self.min_match:
                    for template, place in self.automaton.ends[before[0]]:
                        of_text[template].append(Match(at, place, before[1]))
                before, at = (state, size), at + 1
        if of_text:
            yield text, of_text

    def phrase_places(self, found: Spans, number: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """First word of each place where a phrase stands, counted over all texts."""
        n = len(number) - len(phrase) + 1
        if n < 1:
            return np.empty(0, np.int64)
        same = found.text[:n] == found.text[len(phrase) - 1:]
        for i, word in enumerate(phrase):
            same &= number[i:i + n] == word
        return np.flatnonzero(same)


def chained(matches: Sequence[Match], max_gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of chains of one template that share no word of the file.

    Matches come by their end. Each joins that chain before it, in file and template and at most
    ``max_gap`` words away in both, with which most is covered; words that overlap count once. Chains
    are taken by what they cover, then by where they begin.
    """
    best: list[tuple[int, int]] = []  # words covered, first word
    follows: list[bool] = []
    start = 0
    for i, match in enumerate(matches):
        covered, first, before = match.size, match.end - match.size + 1, -1
        while matches[start].end < match.end - match.size - max_gap:
            start += 1
        for j in range(start, i):
            other = matches[j]
            on_file, in_template = match.end - other.end, match.place - other.place
            added = min(match.size, on_file, in_template)
            apart = max(on_file, in_template) - match.size
            if added > 0 and apart <= max_gap and (best[j][0] + added, -best[j][1]) > (covered, -first):
                covered, first, before = best[j][0] + added, best[j][1], j
        best.append((covered, first))
        follows.append(False)
        if before >= 0:
            follows[before] = True
    chains = sorted((-covered, first, matches[i].end) for i, (covered, first) in enumerate(best) if not follows[i])
    taken: list[tuple[int, int, int]] = []
    for covered, first, last in chains:
        at = _place(taken, first)
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
            taken.insert(at, (first, last, -covered))
    return taken


def _place(taken: list[tuple[int, int, int]], first: int) -> int:
    low, high = 0, len(taken)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if taken[middle][0] < first else (low, middle)
    return low


_SCANNED = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
            "labels array<string>, score double, "
            "spans array<struct<label: string, first: long, last: long, covered: long, share: double>>")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = LICENSE_TEXTS,
                  min_share: float = MIN_SHARE, min_match: int = MIN_MATCH,
                  max_gap: int = MAX_GAP) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row.

    ``templates`` are (label, text). Words are runs of letters, digits and what is not ASCII, A-Z
    lower-cased. ``n_base`` counts the places of `PHRASES`, ``base_labels`` are theirs; ``labels`` has
    those of ``spans`` as well, both sorted. Spans cover at least ``min_share`` of a template;
    ``score`` is the greatest share that any chain of the text covers, 0 without one. A null text is
    empty, repeated rows each have a row, and an empty table gives an empty result. Only doc_id and
    text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, min_match))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = shared.value
        for batch in batches:
            for part in chunks(batch):
                n = part.num_rows
                found, number = scanner.numbered(part.column("text"))
                n_words = np.bincount(found.text, minlength=n)
                base_at = np.cumsum(n_words) - n_words
                n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for phrase, (_, label) in zip(scanner.phrases, PHRASES, strict=True):
                    places = scanner.phrase_places(found, number, phrase)
                    text = found.text[places]
                    np.add.at(n_base, text, 1)
                    np.minimum.at(first, text, places - base_at[text])
                    np.maximum.at(last, text, places - base_at[text])
                    for i in np.unique(text):
                        base[i].add(label)
                score, spans = np.zeros(n), [[] for _ in range(n)]
                for text, of_text in scanner.matches(found, number):
                    for template in sorted(of_text):
                        size = scanner.sizes[template]
                        for begin, end, covered in chained(of_text[template], max_gap):
                            share = covered / size
                            score[text] = max(score[text], share)
                            if share >= min_share:
                                spans[text].append({"label": scanner.labels[template], "first": begin,
                                                    "last": end, "covered": covered, "share": share})
                labels = [sorted(b | {s["label"] for s in found}) for b, found in zip(base, spans, strict=True)]
                nothing = n_base == 0
                schema = _arrow(part.schema.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_base),
                    pa.array(first, mask=nothing), pa.array(last, mask=nothing),
                    pa.array([sorted(b) for b in base], pa.list_(pa.string())),
                    pa.array(labels, pa.list_(pa.string())), pa.array(score),
                    pa.array(spans, schema.field("spans").type)], schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {_SCANNED}")


def _arrow(doc_id: pa.DataType) -> pa.Schema:
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                      ("covered", pa.int64()), ("share", pa.float64())])
    longs = [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    return pa.schema([("doc_id", doc_id), *longs, ("base_labels", pa.list_(pa.string())),
                      ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("spans", pa.list_(span))])


def license_digests(docs: DataFrame) -> DataFrame:
    """`scan_licenses` with both lists of labels as text, without the spans."""
    found = scan_licenses(docs)
    joined = {c: F.concat_ws(",", c) for c in ("base_labels", "labels")}
    return found.withColumns(joined).drop("spans")
