"""The operators applied to whole test tables, by query name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import alignment, chat, clusters, exact, licenses, lines, mixing, neardup, packing, quality, scoring, spans, urls
from eventide.llm.store import find_package

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(build: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        find_package(spark)
        return build(spark, sf)

    _REGISTRY[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query
def op1_chat_formatting(spark, sf):
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return chat.chat_digests(chat.format_chats(turns.unionByName(probe)))


@_query
def op2_lm_scoring(spark, sf):
    return scoring.score_documents(_table(spark, sf, "documents"))


# The rules of the contract.
URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


@_query
def op3_url_filters(spark, sf):
    """Labels name documents; the page of the same number is taken to be where it came from."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return urls.judge_urls(_table(spark, sf, "pages"), labels, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@_query
def op4_best_fit_packing(spark, sf):
    return packing.pack_documents(
        _table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op5_substring_dedup(spark, sf):
    cleaned = spans.drop_repeated_spans(_table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


@_query
def op6_exact_dedup(spark, sf):
    return exact.exact_groups(_table(spark, sf, "documents"))


@_query
def op7_quality_rules(spark, sf):
    return quality.judge_quality(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@_query
def op8_near_duplicates(spark, sf):
    return neardup.near_classes(_table(spark, sf, "documents"))


@_query
def op9_line_dedup(spark, sf):
    cleaned = lines.drop_repeated_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@_query
def op10_source_mixing(spark, sf):
    """Every source gets an equal share of the mix."""
    return mixing.mix_sources(_table(spark, sf, "documents"))


@_query
def op11_centroid_clustering(spark, sf):
    return clusters.clustered(_table(spark, sf, "embeddings"))


@_query
def op12_cross_tokenizer_alignment(spark, sf):
    tokenizers = alignment.Tokenizers(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.alignment_digests(_table(spark, sf, "documents"), tokenizers)


@_query
def op13_license_scans(spark, sf):
    return licenses.license_digests(_table(spark, sf, "documents"))
