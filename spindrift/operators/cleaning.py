"""Cleaning, deduplication and their reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.sources import tables

# Fixed values.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
BUCKETS = 200


def rename_existing(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def cast_existing(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts of the columns that are there; what doesn't parse becomes null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items() if c in df.columns})


def sentinels_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """"" and "-1" in strings, -1 in numbers, and NaN become null."""
    out = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, T.StringType):
            out[field.name] = F.when(~c.isin("", "-1"), c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out[field.name] = F.when(~F.isnan(c) & (c != -1), c)
        elif isinstance(field.dataType, T.NumericType):
            out[field.name] = F.when(c != -1, c)
    return df.withColumns(out)


def to_id(c: Column) -> Column:
    """A whole number from text or a number; "12.0" counts, "1.5" and words give null."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def flag(c: Column) -> Column:
    """1 is true, 0 false, anything else null."""
    return F.when(c == 1, True).when(c == 0, False)


def portuguese_date(c: Column) -> Column:
    """The first "16 de maio de 2022" in the text as 2022-05-16; an impossible date is null."""
    text, pattern = F.lower(c), r"(?U)(\d{1,2}) de (\w+) de (\d{4})"
    day, month, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    iso = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(number > 0, F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


def iso_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "d MMM, yyyy", "MMM d, yyyy", "dd/MM/yyyy")) -> Column:
    return F.date_format(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]), "yyyy-MM-dd")


def price(c: Column) -> Column:
    """"Free" is 0; what is no number is null."""
    return F.when(c == "Free", 0.0).otherwise(c.try_cast("double"))


def profile_key(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def is_vanity(c: Column) -> Column:
    return c.contains("/id/")


def dedup(df: DataFrame, key: str, order: Iterable[str | Column]) -> DataFrame:
    """One row for each key: the first by ``order``, which must decide (a null key is a key)."""
    place = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def dedup_report(df: DataFrame, key: str) -> DataFrame:
    """rows_before, rows_final, dropped: one pass over the keys."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows_before"), F.count("*").alias("rows_final"), F.sum(F.col("n") - 1).alias("dropped"))


def md5_bucket(c: Column, buckets: int = BUCKETS) -> Column:
    """md5 as a whole number modulo ``buckets``, from four 32-bit pieces."""
    digest, shift = F.md5(c), F.lit((1 << 32) % buckets)
    out = F.lit(0).cast("bigint")
    for i in range(4):
        out = F.pmod(out * shift + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    return out.cast("int")


def scatter(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return df.repartition(buckets, key)


def with_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns that a source lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Raw reviews to typed reviews, before deduplication; rows without a critical column go."""
    out = rename_existing(drop_existing(raw, tables.REVIEW_DROPS), tables.REVIEW_NAMES)
    recommended = "is_recommended" in out.columns
    out = cast_existing(out, tables.REVIEW_TYPES)
    if recommended:
        out = out.withColumn("is_recommended", flag(F.col("is_recommended").try_cast("double")))
    out = sentinels_to_null(out.withColumn("game_id", to_id(F.col("game_id"))))
    if "review_date" in out.columns:
        out = out.withColumn("review_date", portuguese_date(F.col("review_date")))
    return out.na.drop(subset=[c for c in tables.CRITICAL if c in out.columns])


def dedup_reviews(cleaned: DataFrame) -> DataFrame:
    return dedup(cleaned, "review_url", [F.md5(F.to_json(F.struct(*sorted(cleaned.columns))))])


def _need(df: DataFrame, columns: Iterable[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def clean_games(raw: DataFrame) -> DataFrame:
    """Raw games (in the source's names or ours) to typed games, one for each game_id; without title or id columns it is an error."""
    out = drop_existing(rename_existing(raw, tables.GAME_NAMES), tables.GAME_DROPS)
    _need(out, ("game_id", "title"))
    out = sentinels_to_null(out).withColumn("game_id", to_id(F.col("game_id")))
    out = out.withColumns({c: iso_date(F.col(c).cast("string")) for c in ("release_date", "early_access_date") if c in out.columns})
    if "price" in out.columns:
        out = out.withColumn("price", price(F.col("price").cast("string")))
    out = out.na.drop(subset=["title", "game_id"])
    return dedup(out, "game_id", [F.md5(F.to_json(F.struct(*sorted(out.columns))))])


def clean_users(raw: DataFrame) -> DataFrame:
    """Raw users (in the source's names or ours) to typed users, one for each steam_id; precomputed toxicity goes."""
    out = drop_existing(rename_existing(raw, tables.USER_NAMES), tables.USER_DROPS)
    _need(out, ("steam_id",))
    types = {c: "string" for c in tables.USER_STRINGS} | {c: "bigint" for c in tables.USER_COUNTERS} | {"has_ban": "boolean"}
    out = sentinels_to_null(cast_existing(out, types))
    return dedup(out, "steam_id", [F.md5(F.to_json(F.struct(*sorted(out.columns))))])


def null_summary(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, the most first."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls").orderBy(F.desc("nulls"), "column")


def describe(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Exact count, mean, std, min, quartiles and max of numeric columns, a row for each."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q.alias("q"), F.max(x).alias("max")))
    one = df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return one.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
