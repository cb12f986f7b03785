"""A training-data pipeline over ``documents``: five of the operators in a row.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last returns a row per token record.

1. toxicity: documents scored 0.5 or more go.
2. near-duplicates: of each component of texts that share 80 % of their five-word shingles the row with the smallest ``doc_id`` stays;
   null ids come last.
3. decontamination: documents that hold a benchmark window go.
4. mixing: documents in training order; a copy is there as often as the mix takes it, whole.
5. token files: written to the shared folder and read back.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtab.llm import decontaminate, mixing, similar, tokenfiles, toxicity
from loomtab.llm.common import extent, pieces, table, written


def frugal(spark: SparkSession) -> SparkSession:
    """Bounds what goes to a Python worker at once: whole texts, from several tasks of an executor. A session's own smaller setting stays."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > most:
        spark.conf.set(key, str(most))
    return spark


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, by a model learnt from the labels that aren't held out."""
    return toxicity.toxicity(docs, table(frugal(spark), sf_dir, "labels")).where("score < 0.5").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, whatever ids its rows have."""
    frugal(spark)
    return similar.first_rows(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.find_contamination(docs, table(frugal(spark), sf_dir, "benchmark")).where("n_hit = 0").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order, by the sources' target weights."""
    _, size = extent(docs, "text")
    return mixing.training_order(mixing.mix_sources(docs, clip=False), pieces(size, 64 << 20, 12)).select("doc.*")


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each copy, from the files."""
    frugal(spark)
    return tokenfiles.read_token_files(tokenfiles.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("token_files", to_token_files)]

#: XXH64 fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
