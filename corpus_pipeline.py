"""From raw documents to packed windows: language, near-duplicates, secrets, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexquarry.llm import language_crf, mixing, related_packing, secrets, superminhash
from lexquarry.llm.common import Scratch
from lexquarry.llm.common import written as written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    return language_crf.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return superminhash.keep_one_each(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources larger than the typical one are tempered, the others stay whole; see mixing.tempered()."""
    return mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of related documents."""
    return related_packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", redaction), ("mixing", mixture), ("packing", packing)]

#: models, signatures and seeded draws: not in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over the table that the one before has written; a table goes when the next is there.

    Nulls in any column are kept but where a stage decides on them: a null, empty or letterless text has no language and goes in
    the first stage; rows without doc_id pass near-duplicates and secrets and go in the mixture, which counts documents; a null
    source is a source of its own. Rows that share a doc_id are one document. Very long texts are worked on whole. Equal texts are
    near-duplicates, of which the least doc_id stays. An empty table gives no rows; other columns pass through to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as tmp:
        before = []
        for name, stage in STAGES[:-1]:
            docs = tmp.written(stage(spark, docs, sf_dir), f"stage-{name}")
            tmp.drop(*before)
            before = [docs]
        return STAGES[-1][1](spark, docs, sf_dir)
