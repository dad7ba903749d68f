"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after every ASCII white-space character is deleted. Digests
that occur very often would land in one task of a plain shuffle; a bounded Misra-Gries summary over
all rows names the candidates, an exact count confirms them, and the winners, at most ``heavy``
rows, are broadcast and their copies never move. The other digests, of which each holds less than
one row in ``HEAVY``, are aggregated before they are shuffled, and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.store import settle, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
HEAVY = 256
# Counters of the summary.
COUNTERS = 4096

_RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def _digests(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.char_length(text).alias("chars"),
        F.sha2(F.translate(text, BLANKS, ""), 256).alias("text_sha256"),
    )


def heavy_digests(digests: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """The ``heavy`` most frequent digests, as the summary ranks them; those that hold more than
    about rows / ``counters`` are ranked right. Others may be missing, and some may be rare."""
    summary = F.expr(f"approx_top_k(text_sha256, {heavy}, {max(heavy, counters)})")
    return digests.agg(summary.alias("top")).select(F.inline("top")).select(
        F.col("item").alias("text_sha256"))


def _group(digests: DataFrame) -> DataFrame:
    # Longest text, then smallest id, then first row: the least of these structs.
    best = F.min(F.struct(
        (-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    return digests.groupBy("text_sha256").agg(
        best.alias("best"), F.count("*").alias("group_size")
    ).select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"),
             F.col("best.row").alias("keep_row"))


def exact_groups(docs: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of equal texts the row with most code points in its original text stays, then the smallest
    doc_id, a missing doc_id last; of rows that agree in both exactly one stays. A null text counts
    as empty, empty texts are equal to each other, and an empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    digests = settle(_digests(docs))
    winners = settle(_group(
        digests.join(F.broadcast(heavy_digests(digests, heavy, counters)), "text_sha256")), heavy)

    frequent = digests.join(F.broadcast(winners), "text_sha256")
    others = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # Counted before the shuffle, one row per digest and task. Written, so that the join starts from
    # files on both sides and a digest that is frequent, but no winner, can be split.
    groups = settle(_group(others))
    return frequent.unionByName(others.join(groups, "text_sha256")).withColumn(
        "kept", F.col("row") == F.col("keep_row")).select(*_RESULT)
