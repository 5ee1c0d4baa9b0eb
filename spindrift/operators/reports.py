"""Counts and shares over the masks: each report is one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import masks, text
from spindrift.sources.tables import per_file

TOTAL = "total"


def percent(part, whole, digits: int = 2):
    return F.round(F.try_divide(part * 100.0, whole), digits)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def agreement_summary(df: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    rows = df if languages is None else df.where(F.col("review_lang").isin(*languages))
    per = rows.groupBy("review_lang").agg(F.count("*").alias("total"), F.count_if(masks.agrees()).alias("agree"))
    return per.withColumn("disagree", F.col("total") - F.col("agree")).withColumn("pct_agree", percent(F.col("agree"), F.col("total")))


def language_validation_summary(df: DataFrame) -> DataFrame:
    detected, declared = F.col("detected_language"), F.col("declared_language")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(detected == declared).alias("match"),
        F.count_if((detected != declared) & (detected != masks.UNDETERMINED)).alias("mismatch"),
        F.count_if(detected == masks.UNDETERMINED).alias("undetermined"),
    )


def mismatch_breakdown(df: DataFrame) -> DataFrame:
    """Rows outside of the validation mask by detected language, with their share of all mismatches."""
    off = df.where(~F.coalesce(masks.declared_or_undetermined(), F.lit(False)))
    per = off.groupBy("detected_language").agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("all"))
    return per.crossJoin(F.broadcast(whole)).select("detected_language", "n", percent(F.col("n"), F.col("all")).alias("pct")).orderBy(F.desc("n"), "detected_language")


def undetermined_breakdown(df: DataFrame, least: int = text.DETECT_LEAST) -> DataFrame:
    """Undetermined rows by cause: empty or gated by length, model without a guess (confidence 0), or inconsistent."""
    cleaned = text.clean_for_detection(F.col("review_text"))
    cause = (
        F.when(F.col("review_text").isNull(), "no_text")
        .when(cleaned == "", "empty_after_cleaning")
        .when(F.length(cleaned) < least, "gated")
        .when(F.coalesce(F.col("detection_confidence"), F.lit(0.0)) == 0, "no_guess")
        .otherwise("inconsistent")
    )
    per = df.where(F.col("review_lang") == masks.UNDETERMINED).groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("all"))
    return per.crossJoin(F.broadcast(whole)).select("cause", "n", percent(F.col("n"), F.col("all")).alias("pct_of_undetermined"))


def boilerplate_impact(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows with boilerplate, by the language found with it (``before``) and without it (``after``)."""
    hit = F.coalesce(F.col("review_text").rlike(text.BOILERPLATE_PATTERN), F.lit(False))
    flips = df.where(hit).groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))
    return flips.withColumn("flip", F.when(~F.col("before").eqNullSafe(F.col("after")), F.concat_ws("->", "before", "after")))


def validity_summary(df: DataFrame) -> DataFrame:
    a, b = F.col("perspective_score"), F.col("detoxify_score")
    sa, sb = masks.score("perspective_score"), masks.score("detoxify_score")
    return df.groupBy("review_lang").agg(
        F.count("*").alias("total"),
        F.count_if(masks.valid()).alias("valid"),
        F.count_if(~sa.between(0, 1)).alias("invalid_perspective"),
        F.count_if(~sb.between(0, 1)).alias("invalid_detoxify"),
        F.count_if(~masks.valid()).alias("invalid_either"),
        F.count_if(~sa.between(0, 1) & ~sb.between(0, 1)).alias("invalid_both"),
        F.count_if(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)).alias("missing"),
    )


def toxicity_sets(df: DataFrame, require_valid: bool = False) -> DataFrame:
    """Sizes of the two models' toxic sets by language, and the total."""
    rows = df.where(masks.valid()) if require_valid else df
    region = masks.venn_region()
    out = rows.rollup("review_lang").agg(
        F.grouping("review_lang").alias("g"),
        F.count("*").alias("n"),
        F.count_if(masks.toxic()).alias("either"),
        F.count_if(region == "both").alias("both"),
        F.count_if(region == "perspective_only").alias("perspective_only"),
        F.count_if(region == "detoxify_only").alias("detoxify_only"),
    )
    return out.withColumn("review_lang", F.when(F.col("g") == 1, TOTAL).otherwise(F.col("review_lang"))).drop("g")


def threshold_agreement(df: DataFrame, first: float = masks.FIRST_TOXIC, second: float = masks.SECOND_TOXIC) -> DataFrame:
    region = masks.venn_region(first, second)
    out = df.where(masks.valid()).groupBy("review_lang").agg(
        F.count_if(region == "both").alias("both"),
        F.count_if(region == "perspective_only").alias("perspective_only"),
        F.count_if(region == "detoxify_only").alias("detoxify_only"),
        F.count_if(region.isNotNull()).alias("either"),
    )
    return out.withColumn("both_pct_of_either", percent(F.col("both"), F.col("either")))


def ascii_art(df: DataFrame, least_share: float = 0.5, least_chars: int = 20, limit: int | None = None) -> DataFrame:
    """Reviews that are mostly drawing characters, the largest share first."""
    t = F.col("review_text")
    out = df.where(masks.ascii_art(t, least_share, least_chars)).select("review_url", text.art_chars(t).alias("art_chars"), text.art_share(t).alias("art_frac"), text.preview(t).alias("preview"))
    out = out.orderBy(F.desc("art_frac"), "review_url")
    return out.limit(limit) if limit else out


def cleaning_stats(df: DataFrame, kept, toxic, cleaned: str, folder: str | None = None) -> DataFrame:
    """Per input file, or per entry of ``folder``: rows, excluded, toxic, empty after cleaning."""
    empty = F.coalesce(F.col(cleaned), F.lit("")) == ""
    return per_file(df, {"rows": F.count("*"), "excluded": F.count_if(~kept), "toxic": F.count_if(kept & toxic), "empty": F.count_if(kept & empty)}, folder)
