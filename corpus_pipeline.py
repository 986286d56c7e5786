"""A corpus pipeline in five stages, each of one operator of ``fsweave.llm``.

Toxic documents go; of near copies one stays; documents with benchmark passages go;
sources are mixed to target weights in whole copies; token ids are written to files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fsweave.llm.common import staged, table
from fsweave.llm.op2_mixing import mix
from fsweave.llm.op4_token_file import round_trip
from fsweave.llm.op5_decontamination import drop_contaminated
from fsweave.llm.op8_toxicity import drop_toxic
from fsweave.llm.op10_jaccard_join import keep_one


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages the calibrated model rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard of 0.8 or more over five-word shingles one stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to packed files and read back."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: SQL cannot express the learned, random and tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
