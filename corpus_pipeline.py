"""A training-data pipeline over ``documents``: five stages, each one an operator of ``spindrift.llm``.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns
the columns of ``documents``; the last one adds the tokens.

Edge cases, alike in all stages: an empty table gives no rows; a null or white text is an empty text
(the classifier decides on it by its bias alone, no document is its copy, it has no secrets, size 0
and no tokens); rows with a null doc_id are documents of their own and no copies; a null source is
a source of its own, the last one; other columns of the input, whatever their names, go on with
their row (in the last stage, one that is named as a column of the tokens gives way to it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import minhash, mixing, pieces, quality, secrets
from spindrift.sources.stage import Stages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """What operators read, and the whole row as one column, so that no name of its columns can clash."""
    return docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("kept_"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(packed(docs), model, keep=("kept_",)).where("predicted = 1").select("kept_.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more).

    Rows that repeat an id and its text stay once, with the least of their other values; texts that
    share an id all stay, if the id does.
    """
    found = minhash.near_duplicates(docs, width=5, share=80, of=100)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = named.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *others)).alias("r")).select("doc_id", "text", *[F.col(f"r.`{c}`").alias(c) for c in others])
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the secret scan is replaced by a mark; no document goes."""
    found = secrets.scan_secrets(packed(docs), keep=("kept_",))
    found = found.select("kept_", F.size("spans").alias("n_spans_"), secrets.redact(F.col("kept_.text"), F.col("spans")).alias("clean_"))
    n_chars = F.when(F.col("n_spans_") > 0, F.length("clean_").cast("long")).otherwise(F.col("kept_.n_chars"))
    anew = {"text": F.col("clean_"), "n_chars": n_chars}
    return found.select(*[anew.get(c, F.col(f"kept_.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: each document as often as the mix takes it."""
    return mixing.draw_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece tokens."""
    tokens = ("n_tokens", "ids", "round_trip")
    out = pieces.encode_documents(packed(docs), keep=("kept_",))
    return out.select(*[F.col(f"kept_.`{c}`").alias(c) for c in docs.columns if c not in tokens], *tokens)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mix", mix_sources), ("encode", encode)]

#: SQL can't express the stages; their tests hold each one against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written and read again."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stages.save(docs, name)
    return docs
