"""A training corpus from raw documents: quality, near-duplicates, secrets, mixture, sequences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreflow.llm import mixing, near_dup, packing, quality, secret_scan
from oreflow.llm.common import table
from oreflow.session import materialize, prepare


SIMILAR = replace(near_dup.SKETCH, percent=80)
"""The corpus drops copies from a similarity of 0.8 on; op4's own threshold is that of its query."""


def text_hash() -> Column:
    """A key of the text as it stands. Decisions belong to rows, and ids may repeat or be missing."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    keyed = docs.withColumn("_hash", text_hash())
    marks = quality.classify(keyed, table(prepare(spark), sf_dir, "labels"), carry="_hash").filter("kept")
    marks = marks.select("doc_id", "lang", F.col("_hash").alias("_mark")).distinct()
    same = keyed["doc_id"].cast("long").eqNullSafe(marks["doc_id"]) & keyed["lang"].eqNullSafe(marks["lang"])
    return keyed.join(marks, same & (keyed["_hash"] == marks["_mark"]), "left_semi").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Of rows with one id and one
    text one stays; different texts under one id are judged each by itself. Documents without an id stay."""
    keyed = docs.withColumn("_hash", text_hash())
    found = near_dup.near_duplicates(keyed, SIMILAR, carry="_hash").filter("kept AND doc_id IS NOT NULL")
    kept = found.groupBy("doc_id", "text_key").agg(F.min("_hash").alias("_hash")).select("doc_id", "_hash").distinct()
    same = Window.partitionBy("doc_id", "_hash").orderBy(F.xxhash64(*docs.columns))
    named = keyed.withColumn("doc_id", F.col("doc_id").cast("long")).join(kept, ["doc_id", "_hash"], "left_semi")
    named = named.withColumn("_turn", F.row_number().over(same)).filter("_turn = 1")
    return named.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with as many words, as the mix of sources takes of them."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

ORACLE_SQL = None
"""Perplexities and token ids are beyond SQL. tests/llm has plain versions of perplexities, secrets, ids and packing, not of the chain."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = table(prepare(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(spark, docs)
    return docs
