"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data is masked, sources are mixed to
target weights, and the texts that are left are encoded.

Each stage is given all that its predecessor kept and returns the columns of documents, the last one the tokens. Defined results of each stage: see
its operator; an empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import _shared as S
from graphloom.llm import op02_toxicity, op03_bpe, op04_pii, op05_simhash, op07_mixing


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_toxicity.drop_toxic(docs, S.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_simhash.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_pii.redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_bpe.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: No SQL has SimHash's or the forest of nearest examples' numbers; tests compare run() with plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written to the shared folder and read again."""
    docs = S.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = S.written(stage(spark, docs, sf_dir), name)
    return docs
