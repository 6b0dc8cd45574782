"""Corpus preparation: quality rules, near duplicates, personal data, source mix, packing.

Every stage takes null and empty texts (the quality rules reject them), null ids (kept as rows; near
duplicates never drop them), repeated rows (one stays in the near-duplicate stage), very long texts
(whole) and empty tables (which stay empty). All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logspark.llm.common import file_order, stored, table
from logspark.llm.jaccard_join import keep_one
from logspark.llm.mixing import TARGETS, mixed
from logspark.llm.packing import pack
from logspark.llm.pseudonyms import DEMO_KEY, pseudonymise
from logspark.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return keep_one(docs, k=5, num=8, den=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal values."""
    return pseudonymise(docs, DEMO_KEY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, by the target weights of sources; the files keep this order."""
    return mixed(docs, weights=TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens, numbered in the order of the mix."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), order=file_order(docs))


#: (name, function) in order; each function takes (spark, docs, sf_dir).
STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packing)]
#: Tokenisation and the model-based stages have no SQL form; the tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
