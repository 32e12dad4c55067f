"""From raw documents to token ids: each stage calls one operator, in a fixed order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import bytebpe, decontaminate, neardup, queries, secrets, toxicity
from tillbook.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on the labelled ones, scores 0.5 or more.

    Null and empty texts score as the bias alone; each row is judged by itself, repeated ones alike.
    """
    queries.prepare(spark)
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(model)(F.col("text")) < 0.5)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id.

    Classes are those of ``neardup.class_of_each``: equal texts are one, null and empty ones
    together; of repeated rows one stays, null ids come last.
    """
    queries.prepare(spark)
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null and empty texts have none and stay, repeated rows go or stay alike."""
    queries.prepare(spark)
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are replaced in the text, and its length is stated anew; documents stay, null texts and repeated rows too."""
    queries.prepare(spark)
    return secrets.redact(docs, length="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, the byte offset after each, and whether decoding gives the text back.

    A null text counts as an empty one, without ids; repeated rows stay.
    """
    queries.prepare(spark)
    path, pattern = queries.vocabulary()
    keep = ["doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")]
    decoded = bytebpe.round_trip(docs, path, pattern, keep=keep)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends", (F.md5("decoded") == F.col("text_md5")).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", token_ids),
]

# A trained classifier, random registers and merges by rank are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
