"""License scans against plain versions that compare every place with every other."""

import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import ROWS, documents, with_clashes

from eventide.llm import licenses, queries
from eventide.llm.license_texts import LICENSE_TEXTS

LABELS = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(text):
    w = plain_words(text)
    places = [(i, label) for phrase, label in LABELS.items() for p in [phrase.split()]
              for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(w), len(places), min(starts, default=None), max(starts, default=None), labels


sequences = st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=4)


@given(sequences, st.lists(st.integers(0, 3), max_size=25))
@settings(max_examples=300, deadline=None)
def test_statistics_and_ends_are_those_of_brute_force(templates, text):
    automaton = licenses.Automaton(templates, min_match=1)
    for at, (state, size) in enumerate(automaton.statistics(text)):
        def places(n):
            run = text[at + 1 - n:at + 1]
            return {(t, i + n - 1) for t, words in enumerate(templates) for i in range(len(words) - n + 1)
                    if words[i:i + n] == run}
        want = max((n for n in range(1, at + 2) if places(n)), default=0)
        assert size == want
        if size:
            assert sorted(automaton.ends[state]) == sorted(places(size))


def test_an_edited_license_is_one_span():
    scanner = licenses.Scanner([("x", " ".join(f"w{i}" for i in range(40)))])
    kept = [f"w{i}" for i in range(40) if i not in (10, 25)]
    text = " ".join(["intro", "of", *kept[:15], "added", "words", *kept[15:], "the", "end", "w3", "w4", "w5"])
    found, number = scanner.numbered(pa.array([text]))
    (_, of_text), = scanner.matches(found, number)
    spans = licenses.chained(of_text[0])
    assert spans == [(2, 41, 38), (44, 46, 3)]


def test_chains_neither_jump_back_nor_far():
    match = licenses.Match
    assert licenses.chained([match(4, 20, 5), match(10, 5, 5)]) == [(0, 4, 5), (6, 10, 5)]
    assert licenses.chained([match(4, 4, 5), match(40, 9, 5)], max_gap=12) == [(0, 4, 5), (36, 40, 5)]
    assert licenses.chained([match(4, 4, 5), match(21, 9, 5)], max_gap=12) == [(0, 21, 10)]
    assert licenses.chained([match(4, 4, 5), match(6, 6, 4)]) == [(0, 6, 7)]


def test_labels_of_notices_and_edited_texts(spark):
    mit = dict(LICENSE_TEXTS[2:3])["mit"]
    texts = {
        1: "Released under the MIT License.", 2: "Licensed under CC BY-NC 4.0.", 3: "All rights reserved.",
        4: "a line\nThis work is licensed under the GNU General Public License, version 3.\nmore",
        5: mit.upper().replace("SUBLICENSE, AND/OR ", ""), 6: "we are permitted to do so with the software",
        7: "Licensed under the Apache License, Version 2.0 " * 40 + "and released under the mit LICENSE",
        8: "licensed under cc by 4.0", 9: "mit-license; MIT\nLicense", 10: "mıt license ｍit license",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert {i: r.labels for i, r in rows.items()} == {
        1: ["mit"], 2: ["cc-by-nc"], 3: ["reserved"], 4: ["gpl"], 5: ["mit"], 6: [], 7: ["apache", "mit"],
        8: ["cc-by"], 9: ["mit"], 10: []}
    assert rows[1].score == rows[3].score == 1 and rows[6].score < 0.75 and rows[10].score == 0
    assert rows[7].n_base == 41 and sum(s.label == "apache" for s in rows[7].spans) == 40
    assert 0.9 < rows[5].score < 1
    for i, r in rows.items():
        for s in r.spans:
            assert 0 <= s.first <= s.last < r.n_words and s.covered <= s.last - s.first + 1


def base_of(row):
    return row.doc_id, row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def test_base_of_awkward_rows(spark):
    rows = [(*r[:2], None, None, None) for r in ROWS]
    got = licenses.license_digests(with_clashes(documents(spark, rows))).collect()
    assert Counter(map(base_of, got)) == Counter((r[0], *plain_base(r[1])) for r in rows)
    assert licenses.license_digests(documents(spark, [])).collect() == []


def test_query_over_the_whole_table(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op13_license_scans"](spark, sf_dir).collect()
    assert Counter(map(base_of, got)) == Counter((r.doc_id, *plain_base(r.text)) for r in texts)
    named = {label for label, _ in LICENSE_TEXTS}
    for r in got:
        found = set(r.labels.split(",")) - {""}
        assert set(r.base_labels.split(",")) - {""} <= found <= named and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(found))
    assert any("cc-by-nc" in r.labels for r in got) == any("CC BY-NC 4.0" in (r.text or "") for r in texts)
