"""Every operator on nulls, empty and long texts, ties, repeats, no rows, and clashing names."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import ROWS, documents, probability_jaccard, shingle_counts, tokenizer_file, with_clashes, words

from eventide.llm import chat, exact, lines, mixing, neardup, packing, quality, scoring, spans, urls

ON_DOCUMENTS = {
    "scoring": scoring.score_documents,
    "packing": lambda d: packing.pack_documents(d, tokenizer_file()),
    "spans": spans.drop_repeated_spans,
    "exact": exact.exact_groups,
    "quality": quality.judge_quality,
    "sound": quality.sound_documents,
    "near": neardup.near_classes,
    "first": neardup.first_of_each_class,
    "lines": lines.drop_repeated_lines,
    "mixing": mixing.mix_sources,
}


def bag(df, columns):
    return Counter(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_no_rows(spark, name):
    assert ON_DOCUMENTS[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_clashing_names_change_nothing(spark, name):
    if name == "packing":  # places may differ, pieces not
        plain = lambda d: packing.cut_pieces(d, tokenizer_file())
    else:
        plain = ON_DOCUMENTS[name]
    docs = documents(spark)
    result = plain(docs)
    assert bag(plain(with_clashes(docs)), result.columns) == bag(result, result.columns)


def test_exact(spark):
    got = exact.exact_groups(documents(spark), heavy=2).collect()
    assert len(got) == len(ROWS)
    by_digest = {}
    for r in got:
        by_digest.setdefault(r.text_sha256, []).append(r)
    for group in by_digest.values():
        assert {r.group_size for r in group} == {len(group)}
        assert sum(r.kept for r in group) == 1
    empty = by_digest[hashlib.sha256(b"").hexdigest()]
    # The blanks of document 3 are the longest original.
    assert {r.keep_id for r in empty} == {3} and len(empty) == 4
    assert {r.keep_id for r in got if r.doc_id in (5, 6)} == {5}


def test_spans(spark):
    got = {}
    for r in spans.drop_repeated_spans(documents(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.text))
    assert got[1] == [(0, 0, None)] and got[2] == [(0, 0, "")]
    assert got[5][0][:2] == (30_000, 0)
    assert [x[:2] for x in got[6]] == [(30_000, 30_000)] * 2
    assert got[7][0][1] == 0
    # The no-break space is part of a word: the passage's last word differs.
    assert got[8] == [(61, 59, "Vorher passage59 nachher")]


def test_repeated_rows_of_one_document_do_not_empty_each_other(spark):
    text = " ".join(f"word{i}" for i in range(80))
    got = spans.drop_repeated_spans(documents(spark, [(1, text, "en", "a", 1)] * 2)).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_lines(spark):
    got = {}
    for r in lines.drop_repeated_lines(documents(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.text))
    assert got[1] == [(1, 0, None)] and got[2] == [(1, 0, "")]
    assert got[9] == [(5, 2, "Alpha\n\nbeta ")]
    assert got[14] == [(3, 1, "text 4\nend ünïcödé \U0001f600")]
    assert got[15][0][:2] == (3, 0)
    assert [x[:2] for x in got[None]].count((2, 1)) == 2


def test_lines_with_full_filters(spark):
    """Filters so small that everything looks repeated: more is confirmed, the result is the same."""
    docs = documents(spark)
    small = lines.drop_repeated_lines(docs, segments=1)
    assert bag(small, small.columns) == bag(lines.drop_repeated_lines(docs), small.columns)


def test_near(spark):
    got = neardup.near_classes(documents(spark)).collect()
    assert len(got) == len(ROWS)
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[6] == classes[5] == 5 and classes[1] == 1 and classes[2] == 2 and classes[3] == 3
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.class_id is None for r in got if r.doc_id is None)
    left = [r.doc_id for r in neardup.first_of_each_class(documents(spark)).collect()]
    assert left.count(5) == 1 and 6 not in left and left.count(None) == 3


def test_one_row_stays_of_a_repeated_document(spark):
    rows = [(1, "one two three four five six", "en", "a", 1)] * 3
    assert neardup.first_of_each_class(documents(spark, rows)).count() == 1


def test_quality(spark):
    got = {}
    for r in quality.judge_quality(documents(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0][1:6] == (0, 0, 0, 0, 0) and got[1][0].base_failed and not got[1][0].kept
    assert got[5][0].n_words == 30_000 and got[9][0].n_dup_lines == 0
    assert len(got[None]) == 3
    # Too few to estimate anything: nobody is rejected by distance.
    assert all(r.kept != r.base_failed for rows in got.values() for r in rows)


def test_mixing(spark):
    docs = documents(spark)
    got = mixing.mix_sources(docs).collect()
    assert len({r.shuffle_key for r in got if r.doc_id not in (6, None)}) == sum(
        r.doc_id not in (6, None) for r in got)
    # Rows without a source hold one word; it is repeated for its full share.
    assert sum(r.source is None and r.doc_id == 4 for r in got) > 100
    nothing = mixing.mix_sources(docs, {"a": 0.0, "b": 1.0}).collect()
    assert {r.source for r in nothing} == {"b"}


def test_packing(spark):
    pieces = packing.pack_documents(documents(spark), tokenizer_file(), with_ids=True).collect()
    assert {(r.doc_id, r.length) for r in pieces if r.doc_id in (1, 2, 3)} == {(1, 1), (2, 1), (3, 1)}
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    assert {r.piece for r in pieces if r.doc_id == 6} == set(range(max(r.piece for r in pieces) + 1))
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        ends = 0
        for offset, length in sorted(placed):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_scoring(spark):
    got = scoring.score_documents(documents(spark), block_chars=5000, part_chars=3000).collect()
    assert len(got) == len(ROWS)
    held_out = {r.doc_id for r in got if r.held_out}
    assert held_out == {d for d, *_ in ROWS if d is not None and zlib.crc32(str(d).encode()) % 7 == 2}
    train = sum(len(words(t)) + 1 for d, t, *_ in ROWS if d not in held_out)
    assert {r.train_tokens for r in got} == {train}
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_chats(spark):
    rows = [
        (1, None, None, None), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, 1, "system", ""),
        (None, 1, "assistant", "x</s>"), (None, 1, "assistant", r"[\INST]"),
        (2, 1, "a[INST]\nb", "<s>\\"), (3, 1, "assistant", "[NEXT" + "]" * 3 + "[" ), (3, 2, "assistant", r"\INST]"),
        (4, 1, "user", "long " * 50_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for frame in (turns, with_clashes(turns)):
        chats = chat.format_chats(frame)
        assert all("".join(p.text for p in r.pieces) == r.formatted for r in chats.collect())
        found = {r.conv_id: [tuple(t) for t in r.turns] for r in chats.select(
            "conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
        for conv in (1, None, 2, 3, 4):
            order = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
            assert found[conv] == [(role, text) for _, _, role, text in order]
    assert chat.chat_digests(chat.format_chats(turns.limit(0))).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "http://A.Example.COM"), (4, "https://x.co.uk/p?q#f"), (4, "https://x.co.uk/p?q#f"),
         (None, "http://bad.org/x"), (6, "http://bad.org/" + "y" * 100_000), (7, "ftp://bad.org?u=://z")],
        "page_id long, url string")
    labels = spark.createDataFrame([(6, 0), (7, 0), (7, 1), (99, 1), (4, None), (None, 1)], "page_id long, good int")
    rules = [urls.Rule("allow", "example.com", "/"), urls.Rule("block", "co.uk", "/")]
    for frame in (pages, with_clashes(pages)):
        got = urls.judge_urls(frame, labels, rules).collect()
        assert Counter((r.page_id, r.host, r.path[:3], r.rule) for r in got) == Counter([
            (1, "", "", None), (2, "", "", None), (3, "a.example.com", "", None),
            (4, "x.co.uk", "/p", "co.uk/"), (4, "x.co.uk", "/p", "co.uk/"), (None, "bad.org", "/x", None),
            (6, "bad.org", "/yy", None), (7, "bad.org", "", None)])
        assert {r.verdict for r in got if r.rule} == {"block"}
        assert len({r.verdict for r in got if r.host == "bad.org"}) == 1
    assert urls.judge_urls(pages.limit(0), labels, rules).count() == 0
    unlabelled = urls.judge_urls(pages, labels.limit(0), []).collect()
    assert {r.verdict for r in unlabelled} == {"allow"}


def test_sample_similarity_is_symmetric():
    a, b = shingle_counts("a b c d e f g"), shingle_counts("a b c d e f h a b c d e")
    assert probability_jaccard(a, b) == pytest.approx(probability_jaccard(b, a))
