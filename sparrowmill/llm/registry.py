"""The queries of the language-model operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparrowmill.llm import bpe, exact_dedup, html_extract, jaccard_join, language, lexical_search, line_dedup, mixing, neighbours, quality, toxicity, url_filter, vector_codes
from sparrowmill.llm.scratch import read


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predicted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), word_vocabulary())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.fresh_index(spark)
    out = exact_dedup.dedup(read(spark, sf_dir, "documents"), index, largest_first=True)
    index.drop()  # an index of one run; the result reads what was written beside it
    return out


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.told(read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.searched(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read(spark, sf_dir, "embeddings"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"))


OPERATORS = (op1_quality, op2_neighbours, op3_bpe, op4_exact_dedup, op5_line_dedup, op6_html, op7_language, op8_toxicity, op9_jaccard_join, op10_mixing, op11_search, op12_codes, op13_urls)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {"op4_exact_dedup": exact_dedup.ORACLE, "op10_mixing": mixing.oracle(), "op11_search": lexical_search.oracle(), "op12_codes": vector_codes.oracle()}
