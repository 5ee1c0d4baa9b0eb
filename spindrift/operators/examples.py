"""Examples with their context, and samples that a hash decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import masks, text
from spindrift.operators.cleaning import with_missing
from spindrift.sources.stage import Stages

COLUMNS = ("review_url", "user_url", "game_id", "game_name", "review_lang", "review_text", "perspective_score", "detoxify_score", "sentiment_score", "topic")


def hash_order(key: str | Column, seed: int) -> Column:
    """A seeded order that both engines can give: md5 of seed and key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    place = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= n).drop("_r")


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * rows) rows, half to even."""
    return sample_rows(df, round(fraction * df.count()), key, seed).orderBy(key)


def unit(key: str | Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the key's hash."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split_negatives(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``part``: test for a fixed share of the negatives, train for the others; positives are marked as such."""
    return df.withColumn("part", F.when(F.col(label), "positive").when(unit(key, seed) < test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0 to k - 1: each label's rows dealt round in hash order."""
    return numbered(df, label, key, seed).withColumn("fold", ((F.col("_n") - 1) % k).cast("int")).drop("_n")


def numbered(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """``_n``: a row's place (from 1) in the hash order of its label's rows.

    Hash prefixes cut the order into slices; their counts, a few thousand a label, give each slice's
    first place, so no task holds a whole label.
    """
    cut = df.withColumn("_h", hash_order(key, seed)).withColumn("_s", F.substring("_h", 1, 3))
    counts = cut.groupBy(F.col(label).alias("_l"), F.col("_s").alias("_t")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_l").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("_l", "_t", F.coalesce(before, F.lit(0)).alias("_b"))
    place = Window.partitionBy(label, "_s").orderBy("_h", key)
    out = cut.withColumn("_r", F.row_number().over(place)).join(first, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_t")))
    return out.withColumn("_n", F.col("_b") + F.col("_r")).drop("_h", "_s", "_r", "_l", "_t", "_b")


def draw_balanced(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement under balanced weights (``draw`` 0 to n - 1): a class by hash, then one of its rows."""
    rows = numbered(df, label, key, seed)
    classes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    order = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "_size"))).alias("_classes"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(order))
    pick = lambda salt, size: F.least(F.floor(unit("draw", seed + salt) * size), size - 1)
    draws = draws.withColumn("_one", F.get("_classes", pick(1, F.size("_classes")).cast("int")))
    draws = draws.select("draw", F.col("_one.label").alias("_l"), (pick(2, F.col("_one._size")) + 1).alias("_m"))
    return rows.join(draws, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_n") == F.col("_m"))).select("draw", *df.columns)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights under which both classes are drawn as often."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(sizes), label).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def capped_users(df: DataFrame, label: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` users, half of them positive where there are as many."""
    positive = sample_rows(df.where(F.col(label)), most // 2, key, seed)
    return positive.unionByName(sample_rows(df.where(~F.col(label)), most - most // 2, key, seed))


def pick(df: DataFrame, n: int, toxic: bool | None = None, venn: str | None = None, contains: str | None = None, games: DataFrame | None = None, tag: str | None = None, seed: int = 42) -> DataFrame:
    """Agreeing, valid reviews that pass the filters, n of them; exactly one of ``toxic`` and ``venn`` is given."""
    if (toxic is None) == (venn is None):
        raise ValueError("give either toxic or venn")
    rows = df.where(masks.agrees() & masks.valid())
    rows = rows.where(masks.in_venn_region(venn)) if venn else rows.where(masks.toxic() if toxic else ~masks.toxic())
    if contains:
        rows = rows.where(masks.contains_literal("review_text", contains))
    if tag:
        rows = rows.join(games.where(masks.has_tag(F.col("popular_tags"), tag)).select("game_id"), "game_id", "left_semi")
    return sample_rows(rows, n, "review_url", seed)


def with_context(sample: DataFrame, games: DataFrame | None = None, sentiment: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
    """A sample with game names, sentiment and topics; a source that is missing gives nulls.

    The sample is written first, so that it is picked once and its size is known: the large tables
    are cut to its keys (by broadcast while it is small), then joined.
    """
    sample = Stages(sample.sparkSession, "examples").save(sample, "sample")
    out = sample
    if games is not None:
        out = out.join(games.select("game_id", F.col("title").alias("game_name")), "game_id", "left")
    for source, column in ((sentiment, "sentiment_score"), (topics, "topic")):
        if source is not None:
            own = source.join(sample.select("review_url"), "review_url", "left_semi").select("review_url", column)
            out = out.drop(column).join(own, "review_url", "left")
    out = with_missing(out, {"game_name": "string", "sentiment_score": "double", "topic": "int"})
    return out.withColumn("review_text", text.clean_for_examples(F.col("review_text"))).select(*[c for c in COLUMNS if c in out.columns])
