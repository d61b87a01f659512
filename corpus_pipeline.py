"""Training-data pipeline over documents: five stages, each on all that the stage before it kept.

Every stage but the last returns the columns of documents. Null texts, empty texts, null doc_ids, repeated rows and different
texts under one doc_id are taken as the operators' docstrings say; other columns of any name pass through the first four stages.
What a stage writes on its way is deleted when its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import op2_bpe, op5_decontaminate, op8_quality_pu, op9_suffix_dedup, op10_probminhash
from sitelens.llm.common import materialise, named, read_table, remove_steps, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go."""
    model = op8_quality_pu.learn(docs, read_table(spark, sf_dir, "labels"))
    return op8_quality_pu.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class the first text stays (smallest doc_id), and of repeated rows one. Rows without doc_id all stay."""
    return op10_probminhash.first_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeated passages are taken out of the texts; characters that lose only some of their bytes go whole."""
    kept = op9_suffix_dedup.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*named(*docs.columns)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a window of a benchmark item go."""
    return op5_decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: number and digest of the ids of each text that is left, and of the text decoded from them."""
    return op2_bpe.digests(docs, public_tokenizers.path(op2_bpe.TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", passages),
    ("benchmark decontamination", decontamination),
    ("bpe tokens", tokens),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mark = written()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove_steps(spark, mark, keep=1)
    return docs
