"""Registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from oreflow.llm import (
    language,
    mixing,
    near_dup,
    packing,
    pages,
    quality,
    runs,
    secret_scan,
    suffixes,
    token_counts,
    topk,
    vectors,
    whitening,
)
from oreflow.llm.common import table
from oreflow.llm.sql import SQL
from oreflow.session import prepare

__all__ = ["QUERIES", "SQL"]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_ids(table(prepare(spark), folder, "documents"))


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = mixing.sized(table(prepare(spark), folder, "documents"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(prepare(spark), folder, "documents"))


def op4_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(prepare(spark), folder, "documents"))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(prepare(spark), folder, "pages"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(prepare(spark), folder, "documents")).select("doc_id", "n_tokens")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(prepare(spark), folder, "documents"), table(spark, folder, "labels"))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(prepare(spark), folder, "embeddings"))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(prepare(spark), folder, "documents")))


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(prepare(spark), folder, "embeddings")
    return topk.top_k(rows.filter(F.col("vec_id") % 20 == 0), rows)


def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(prepare(spark), folder, "documents")))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(prepare(spark), folder, "embeddings"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(table(prepare(spark), folder, "documents"), plant=True))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_source_mix,
        op3_best_fit_packing,
        op4_minhash_dedup,
        op5_html_text,
        op6_token_counts,
        op7_quality,
        op8_embedding_dedup,
        op9_secret_scan,
        op10_exact_top_k,
        op11_suffix_dedup,
        op12_whitening,
        op13_periodic_runs,
        pipeline,
    )
}
