"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillgraph.llm import format_dups, leaks, mixture, near_dups, pieces, quality, same_look, terms
from rillgraph.sources.scratch import table


#: The public tokenizer that the mixture counts with.
TOKENIZER = os.environ.get("RILLGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look.found(table(spark, folder, "review_example"), table(spark, folder, "review_case"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return same_look.lookalike_classes(table(spark, folder, "review_example"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.found(table(spark, folder, "review_example"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.groups(table(spark, folder, "review_example"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_dups.found(table(spark, folder, "review_example"))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return format_dups.records(table(spark, folder, "review_example"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.found(table(spark, folder, "review_example"), table(spark, folder, "corpus_graph"))


def p4_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return terms.all_frequencies(table(spark, folder, "review_example"), table(spark, folder, "corpus_graph"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.found(table(spark, folder, "review_example"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split(table(spark, folder, "review_example"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"), TOKENIZER)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_target")
    return mixture.reached(mixture.mixture(table(spark, folder, "documents"), targets, TOKENIZER), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.found(table(spark, folder, "documents"))


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_groups, p3_found, p3_records, p4_found, p4_frequencies, p5_found, p5_pieces, p6_found, p6_leaks, p7_mixture, p7_shares, p8_found, p8_quality)
}
# White space as the stored texts can have it, in the syntax of RE2.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The other results need the consistent form, a tokenizer or alignment, which SQL doesn't have.
SQL: dict[str, str] = {
    "p5_found": f"select doc_id, case when regexp_matches(text, '[^{_SPACE}。！？；.!?;]{{801}}') then 'hard' else 'natural' end as kind from review_example where length(text) > 800",
}
