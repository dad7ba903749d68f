"""Words, lines and runs of words that differ have different hashes, also where sums would cancel."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import tokenizer_file

from eventide.llm import lines, packing, spans
from eventide.llm.words import grams, lines as line_spans, words

SWAP = str.maketrans("ab", "ba")


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("size", [2, 64, 1024, 8192])
def test_thue_morse_words_lines_and_runs(size):
    one, other = thue_morse(size), thue_morse(size).translate(SWAP)
    found = words(pa.array([f"{one} {other}", f"x {one}"])).hash
    assert found[0] != found[1] and found[0] == found[3]
    found = line_spans(pa.array([f"{one}\n {other}\n{one.upper()} "])).hash
    assert found[0] != found[1] and found[0] == found[2]
    pair = words(pa.array(["a b"])).hash
    of = [grams(pair[[int(c == "b") for c in text]], size)[0] for text in (one, other)]
    assert of[0] != of[1]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 50, 97])
def test_a_run_hashes_alike_wherever_it_stands(size):
    values = np.arange(97, dtype=np.uint64) * np.uint64(99_991)
    found = grams(values, size)
    assert len(found) == 98 - size == len(set(found.tolist()))
    assert all(grams(values[i:i + size], size)[0] == found[i] for i in range(len(found)))


def test_spans_that_differ_in_one_long_word_stay(spark):
    shared = " ".join(f"s{i}" for i in range(49))
    texts = [(1, f"{shared} {thue_morse(1024)}"), (2, f"{shared} {thue_morse(1024).translate(SWAP)}"),
             (3, f"{shared} {thue_morse(1024)} end")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in spans.drop_repeated_spans(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_lines_of_one_text_are_told_apart_exactly(spark):
    one, other = thue_morse(1024), thue_morse(1024).translate(SWAP)
    docs = spark.createDataFrame([(i, f"{one}\n{other}\nown {i}") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.drop_repeated_lines(docs).collect()}
    assert got == {**dict.fromkeys(range(5), 2), 5: 0}


def test_ids_of_long_words_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [f"{thue_morse(1024)} {thue_morse(1024).translate(SWAP)}", thue_morse(1024).translate(SWAP)]
    tokenizer = Tokenizer.from_file(tokenizer_file())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack_documents(docs, tokenizer_file()).orderBy("doc_id", "piece").collect()
    for doc, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert sum(p.length for p in pieces if p.doc_id == doc) == len(ids)
        want = [zlib.crc32(np.array(ids[i:i + 2048], "<u4").tobytes()) for i in range(0, len(ids), 2048)]
        assert [p.ids_crc32 for p in pieces if p.doc_id == doc] == want
