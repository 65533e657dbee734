"""From raw documents to packed training sequences: five stages, each an operator of ``copyrisk.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet to the
shared scratch folder and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.  Null and empty texts are scored, never near-duplicates, hold no test
item and no personal data, and pack as one end token if the classifier keeps them.  An empty
table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from copyrisk.llm.boosting import drop_low_quality
from copyrisk.llm.decontaminate import drop_contaminated
from copyrisk.llm.near_dup import drop_near_duplicates
from copyrisk.llm.packing import pack_documents
from copyrisk.llm.pii import mask_personal_data
from copyrisk.llm.scratch import bounded_batches, stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score below the cut go."""
    bounded_batches(spark)  # for the stages after it, too
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by kind; no document goes.  ``n_chars`` stays that of the source text."""
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models and a tokenizer take part, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
