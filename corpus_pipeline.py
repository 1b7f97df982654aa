"""A training-data pipeline over ``documents``: toxicity, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``.  :func:`run` writes each stage as Parquet into the shared folder and reads it again as
the next one's ``docs``.  Labels come from the ``labels`` table of ``sf_dir``.

Every row is judged by its own text, also where its doc_id is null or shared by other texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import minhash, packing, quality, queries, secrets, toxicity
from tidewire.llm.shared import table
from tidewire.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as label 0 go."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mask."""
    return secrets.redact(docs, queries.secret_model(spark, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in windows of 2,048."""
    return packing.pack_documents(docs, queries.tokenizer_path(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs


#: SQL can express neither trained models nor near-duplicate groups; tests hold the stages against brute force.
ORACLE_SQL = None
