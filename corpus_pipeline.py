"""The corpus pipeline: each stage works on what the one before it kept, written as Parquet in between.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark passages go, secrets
are marked out, and what is left is encoded and decoded. A document whose text the secret scan changes stays.

Rows with a null text stay null until the last stage, which encodes them as empty; for near-duplicates a null text is an
empty one. Rows with a null id count like any other, and stand for their group only if no row of it has an id. Repeated
rows are copies of each other, so one stays. An empty table passes all stages and stays empty. Columns that documents has
beyond those used are carried along, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import bpe, decontamination, secrets, simhash, toxicity
from palimpsest.llm.common import documents
from palimpsest.operators.log import delete_prefix
from palimpsest.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learned(spark, sf_dir))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, decontamination.blocks(documents(spark, sf_dir, "benchmark")))


def mark_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    found = secrets.redact_secrets(docs, secrets.train())
    if "n_chars" not in found.columns:
        return found
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", mark_out_secrets),
    ("bpe", encode_and_decode),
]

#: SQL can't express a trained classifier, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again.

    What a stage wrote is deleted once the next one has written; the last is what the result is read from.
    """
    docs, before = documents(spark, sf_dir), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete_prefix(spark, before)
            before = path
    return docs
