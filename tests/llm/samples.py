"""Rows with nulls, empty and long texts, ties and repeats, and plain versions of the operators' rules."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations
from pathlib import Path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

_LONG = " ".join(f"w{i % 977}x{i % 1009}" for i in range(30_000))
_SHARED = " ".join(f"passage{i}" for i in range(60))
_LINE = "This line of boilerplate is long enough to be counted everywhere."

ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t\x0b\x0c\r ", "en", "a", 7),
    (4, "short", "en", None, 5),
    (5, _LONG, "en", "b", len(_LONG)),
    (6, _LONG, "en", "b", len(_LONG)),
    (6, _LONG, "en", "b", len(_LONG)),
    (7, f"before {_SHARED} after", "de", "a", None),
    (8, f"Vorher\n{_SHARED} nachher", "de", "a", None),
    (9, f"{_LINE}\nAlpha\n\n {_LINE.upper()} \nbeta ", "fr", "a", None),
    *[(10 + i, f"text {i}\n{_LINE}\t\nend ünïcödé \U0001f600", "fr", "b", None) for i in range(6)],
    (None, f"nobody\n{_LINE}", None, "b", None),
    (None, f"nobody\n{_LINE}", None, "b", None),
    (None, None, None, None, None),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# Names the operators use inside themselves.
CLASHES = ("row", "body", "spans", "drop", "digest", "key", "band", "bands", "node", "label", "center",
           "a", "b", "u", "v", "m", "n", "bin", "z0", "m0", "c00", "l00", "distance", "large", "block", "kind",
           "part", "cdf", "at", "count", "rate", "weight", "chars", "item", "best", "group_size", "keep_id",
           "turns", "pieces", "formatted", "host", "path", "good", "prior", "upper", "copy", "shuffle_key",
           "n_lines", "n_dropped", "n_words", "n_removed", "kept", "start", "length", "sequence_id", "offset")


def with_clashes(df):
    from pyspark.sql import functions as F

    names = [c for c in CLASHES if c not in df.columns]
    return df.withColumns({c: F.lit(f"own {c}") for c in names})


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_counts(text: str | None) -> Counter:
    w = words(text)
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def probability_jaccard(a: Counter, b: Counter) -> float:
    kinds = Counter((a[x], b[x]) for x in a.keys() & b.keys())
    only_a, only_b = (sum(n for x, n in p.items() if x not in q) for p, q in ((a, b), (b, a)))
    return sum(n / (only_a / x + only_b / y + sum(m * max(p / x, q / y) for (p, q), m in kinds.items()))
               for (x, y), n in kinds.items())


def jaccard(a: Counter, b: Counter) -> float:
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys())


def linked_classes(texts: dict) -> dict:
    """Class of each document, by comparing every two that share a shingle."""
    sets = {d: shingle_counts(t) for d, t in texts.items()}
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {p for ds in holders.values() for p in combinations(sorted(ds), 2)}:
        if jaccard(sets[a], sets[b]) >= 0.8 - 1e-9:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: root(d) for d in sets}


def read_texts(spark, sf_dir: str) -> dict[int, str]:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", "text").collect()}


def tokenizer_file() -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path("word_bpe_49k.json")))
