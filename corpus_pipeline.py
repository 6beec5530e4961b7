"""A training corpus from ``documents``: quality rules, exact and near deduplication, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows it keeps with the
columns of ``docs``, the last one the packed pieces. ``run`` applies them in order, writing each result as Parquet to
the folder that all executors share and reading it back for the next; what a stage has read is deleted once its own
result is written. The last result has the texts of the pieces, so it stands for itself.

Nulls, empty texts and repeated rows are treated as each operator's docstring says. Where a stage removes rows by id,
rows without an id stay, except as copies of another row in exact deduplication.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import exact_dedup, mixing, near_dedup, packing, quality
from turnweave.llm._session import checkpoint_dir, cut, fresh, remove, table

POLICY = "v1"


def _without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The documents but those whose id is in the one column of ``lost``."""
    lost = lost.toDF(fresh(docs.columns, "lost"))
    return docs.join(lost, docs["doc_id"] == lost[lost.columns[0]], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps.

    A null or empty text has no words and goes. Repeated rows are judged each; ids play no part.
    """
    name = fresh(docs.columns, "ledger")
    return quality.ledger(docs, name=name).where(quality.passes(POLICY, name)).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z read as a-z, null as empty) the row with the largest id.

    A row without an id stays only if none of its copies has one, and then one row of them. Rows that repeat id and text
    are copies; rows of one id and different texts are told apart by text.
    """
    found = cut(exact_dedup.exact_dedup(docs))  # narrow, and read twice
    unclear = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if unclear.isEmpty():
        return _without(docs, found.where("NOT kept").select("doc_id"))
    # ids that repeat, or are missing: rows are told apart by text as well, and of alike rows one stays
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digest, name, other = (fresh(docs.columns, x) for x in ("digest", "stays", "stays_digest"))
    keyed = docs.withColumn(digest, F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256))
    stays = found.where("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(other))
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(digest) == F.col(other))
    return keyed.join(stays, same, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the lowest id.

    Rows that share an id are one document of several texts and stay or go together; rows without an id stay.
    """
    return _without(docs, near_dedup.near_dedup(docs).where("NOT kept AND doc_id <> class_id").select("doc_id").distinct())


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents left out, kept or repeated such that the expected tokens have the target mixture.

    Nulls in source or language are values of their own; rows alike in id and text share their fate.
    """
    name = fresh(docs.columns, "mix")
    return mixing.repeated(mixing.mix(docs, name=name), name).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of permitted lengths, with their texts.

    A null or empty text is one empty piece; each copy of a row is packed.
    """
    return packing.with_texts(packing.pack(docs), docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixing_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Near deduplication has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{n}_{name}")
            docs = spark.read.parquet(f"{folder}/{n}_{name}")
            if n:
                remove(spark, f"{folder}/{n - 1}_{STAGES[n - 1][0]}")
    return docs
