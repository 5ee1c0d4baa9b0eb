"""The thin queries over the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import ann, brown, minhash, mixing, oracles, pages, pieces, pq, quality, secrets, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, share=80, of=100)


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_documents(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), "n_live"
    )


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        op1_minhash_near_dedup,
        op2_ann_search,
        op3_suffix_dedup,
        op4_embedding_near_dedup,
        op5_sentencepiece,
        op6_quality,
        op7_brown_lm,
        op8_mix_sources,
        op9_secret_scan,
        op10_html_extract,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": oracles.OP1, "op4_embedding_near_dedup": oracles.OP4, "op9_secret_scan": oracles.OP9}
