"""A cleaning pipeline for training text: each stage works on all that the one before kept.

Toxic documents go, one document of each group of near copies stays, documents that hold benchmark passages go, personal
data is masked, and what is left is encoded (and decoded again as a check on itself).

Null texts count as empty: they are clean, stand alone and stay.  Rows with a null id stay too; rows of one id stand or go
together, once each.  An empty table gives an empty result.  Columns other than doc_id and text go through every stage
unread, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sphaera.llm import bpe, decontaminate, neardup, pii, toxicity
from sphaera.llm.common import drop_written, materialise, read_table, written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs, width=5, percent=80)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def stage_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("personal_data", stage_personal_data),
    ("encoding", stage_encoding),
]

#: SQL can express neither the trained models nor merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), set(written())
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        # what the stage and the ones before it wrote on the way is needed no more
        drop_written(spark, keep=before | set(written()[-1:]))
    return docs
