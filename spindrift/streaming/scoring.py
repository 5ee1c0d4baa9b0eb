"""The scoring plan and toxicity counts over a stream of reviews."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import masks, text
from spindrift.operators.scoring import hash_scorer, score_texts


def score_stream(stream: DataFrame, languages: Sequence[str], column: str = "detoxify_score", scorer: Callable = hash_scorer) -> DataFrame:
    """Agreeing reviews with a fresh score; stateless, so it recovers from its checkpoint alone."""
    return stream.where(masks.agrees(languages)).withColumn(column, score_texts(text.clean_for_scoring(F.col("review_text")), scorer))


def toxic_counts(stream: DataFrame, time: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Valid and toxic reviews by window and language; rows later than ``late`` are left out."""
    rows = stream.where(masks.valid()).withWatermark(time, late)
    return rows.groupBy(F.window(time, every), "review_lang").agg(F.count("*").alias("n"), F.count_if(masks.toxic()).alias("n_toxic"))


def dedup_stream(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """First rows by key, remembered for ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
