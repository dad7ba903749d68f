"""Alignment of two tokenizers against plain versions that go token by token."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import ROWS, documents, with_clashes
from tokenizers import Tokenizer

from eventide.llm import alignment, queries

TOKENIZERS = alignment.Tokenizers(
    P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
ODD = ["", None, " ", "  two  spaces ", "\n", "a\tb\r\n", "it's <s> </s> <unk> <|endoftext|>", "▁ x", "\x00y",
       "naïve \U0001f600​", "　中文 字", "é", "x" * 3000, "ﬁ ½ Ⅳ", "  ", "ÀÉ<0x41>"]


def byte_of():
    """The letters that byte-level files write for bytes, built from their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        self.bytes = byte_of()

    def ids(self, text):
        if not text:
            return [], []
        a = self.a.encode(f" {text}", add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.bytes[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b for p in [self.b.id_to_piece(i)]]
        if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            return [], []
        return list(zip(a, np.cumsum([*map(len, bytes_a)]).tolist(), strict=True)), list(
            zip(b, np.cumsum([*map(len, bytes_b)]).tolist(), strict=True))

    def groups(self, text):
        a, b = self.ids(text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups = [([], []) for _ in cuts]
        for side, own in enumerate((a, b)):
            for token, end in own:
                groups[bisect_left(cuts, end)][side].append(token)
        return groups, a, b

    def digests(self, rows):
        count, each = Counter(), []
        for doc, text in rows:
            groups, a, b = self.groups(text)
            links = [(x[-1], y[-1]) for x, y in groups]
            count.update(links)
            each.append((doc, len(a), len(b), groups, links))
        highest = defaultdict(int)
        for (_, y), n in count.items():
            highest[y] = max(highest[y], n)
        out = []
        for doc, n_a, n_b, groups, links in each:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((doc, n_a, n_b, len(groups), len(links), sum(count[p] == highest[p[1]] for p in links),
                        sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return Counter(out)


@given(st.lists(st.tuples(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40))), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_common_ends_are_the_intersection(texts):
    ends, closing, base = ([], []), ([], []), 0
    for one, other in texts:
        for side, own in enumerate((one, other)):
            ends[side].extend(base + e for e in sorted(own | {41}))
            closing[side].append(len(ends[side]) - 1)
        base += 41
    found = alignment.common_ends(*map(np.array, ends), *map(np.array, closing))
    want = sorted(set(ends[0]) & set(ends[1]))
    assert [ends[0][i] for i in found[0]] == want == [ends[1][i] for i in found[1]]


def test_digests_of_awkward_texts(spark):
    rows = [(r[0], r[1]) for r in ROWS] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = with_clashes(documents(spark, [(*r, None, None, None) for r in rows]))
    got = alignment.alignment_digests(docs, TOKENIZERS, block_bytes=1 << 16).collect()
    assert Counter(map(tuple, got)) == Plain().digests(rows)


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_cross_tokenizer_alignment"](spark, sf_dir).collect()
    assert Counter(map(tuple, got)) == Plain().digests(rows)


def test_tokens_and_cuts(spark):
    texts = [t for t in ODD if t] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    plain = Plain()
    rows = alignment.aligned_tokens(docs, TOKENIZERS).collect()
    assert len(rows) == len(texts)
    for row in rows:
        groups, a, b = plain.groups(texts[row.doc_id])
        assert row.a == [i for i, _ in a] and row.b == [i for i, _ in b]
        assert [x for x, _ in groups] == [row.a[i:j] for i, j in zip([0, *row.cuts_a], row.cuts_a)]
        assert [y for _, y in groups] == [row.b[i:j] for i, j in zip([0, *row.cuts_b], row.cuts_b)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, ""), (None, "")]])
def test_nothing_to_align(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.alignment_digests(docs, TOKENIZERS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, 0, 0, 0, 0, 0, 0, "")) for d, _ in rows)
