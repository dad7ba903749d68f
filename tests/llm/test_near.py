"""Near-duplicates whose differing shingles repeat."""

import pytest
from samples import linked_classes

from eventide.llm import neardup


@pytest.mark.parametrize("one_side", [False, True])
def test_pairs_that_differ_in_what_repeats(spark, one_side):
    """A changed name in a line that recurs: sets are similar, weighted sets are not."""
    texts = {}
    for pair in range(30):
        passage = " ".join(f"p{pair}w{i}" for i in range(124))
        for side in range(2):
            line = " ".join(f"p{pair}s{side}x{i}" for i in range(10 if side or not one_side else 0))
            texts[10 * pair + side] = f"{passage}\n" + f"{line}\n" * 50
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    want = linked_classes(texts)
    assert got == want and len(set(want.values())) == 30
