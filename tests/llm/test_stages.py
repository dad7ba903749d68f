"""Every stage of the corpus pipeline on nulls, empty and long texts, ties, repeats and clashing names."""

import pytest
from samples import ROWS, documents, with_clashes

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
FILTERS = [name for name in STAGES if name != "best_fit_packing"]


@pytest.mark.parametrize("name", STAGES)
def test_awkward_rows(spark, name):
    docs = with_clashes(documents(spark))
    got = STAGES[name](spark, docs, "")
    if name in FILTERS:
        assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    texts = {i: text for i, text, *_ in ROWS}
    if name == "quality_rules":
        # All others have fewer than fifty words.
        assert set(ids) <= {5, 6, 7, 8} and ids.count(6) in (0, 2)
    elif name == "line_dedup":
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)
    elif name == "near_duplicates":
        assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 3
    elif name == "best_fit_packing":
        assert set(ids) == set(texts)
    assert set(ids) <= set(texts)


@pytest.mark.parametrize("name", STAGES)
def test_no_rows(spark, name):
    docs = documents(spark, [])
    assert STAGES[name](spark, docs, "").collect() == []
