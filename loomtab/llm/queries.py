"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, lexical, mixing, quality, secrets, simhash, substring, tiff, tokencount, tokenfiles, toxicity, urls
from .common import pieces, table

WINDOW, END_ID = 20, 2


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeated_windows(table(spark, sf_dir, "documents"), WINDOW))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.digest(mixing.mix_sources(docs), pieces(docs.count(), 1 << 20, 12))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return tokenfiles.read_token_files(manifest)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(urls.judge(table(spark, sf_dir, "pages")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return lexical.search(lexical.index(table(spark, sf_dir, "documents"), lexical.item_terms(items)), items)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_substring_dedup, op2_source_mixing, op3_token_files, op4_secret_scan, op5_url_filter, op6_toxicity, op7_token_count, op8_tiff_pages, op9_simhash, op10_decontaminate, op11_quality_rules, op12_lexical_search, op13_tokenizer_alignment]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring.ORACLE, "op2_source_mixing": mixing.ORACLE, "op5_url_filter": urls.oracle(), "op10_decontaminate": decontaminate.ORACLE, "op12_lexical_search": lexical.ORACLE}
