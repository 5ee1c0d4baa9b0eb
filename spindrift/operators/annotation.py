"""Inter-annotator agreement by score bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import bin_floor

# The annotators' column sets and the bin columns.
ANNOTATORS = (("paula", "marcus", "lorena"), ("P", "L", "M"))
BINS = ("perspective_bin", "detoxify_bin")


def annotator_columns(df: DataFrame) -> tuple[str, ...]:
    for names in ANNOTATORS:
        if all(c in df.columns for c in names):
            return names
    raise ValueError(f"no full annotator set among {df.columns}")


def even_bins(df: DataFrame, columns: tuple[str, ...] = BINS) -> DataFrame:
    """(column, bins, even): was a column's every bin sampled with as many rows (and is there more than one)?"""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bin")) for c in columns])).alias("r")).select("r.*").where("bin is not null")
    per = rows.groupBy("column", "bin").agg(F.count("*").alias("n"))
    return per.groupBy("column").agg(F.count("*").alias("bins"), ((F.count_distinct("n") == 1) & (F.count("*") > 1)).alias("even"))


def votes_of(df: DataFrame, columns: tuple[str, ...], fill_missing: bool = False) -> DataFrame:
    """``df`` with the array ``votes`` of complete rows.

    A row with a blank goes, or with ``fill_missing`` the blanks take the strict majority of the
    votes there are; without one the row goes.
    """
    given = F.array(*[F.col(c).cast("int") for c in columns])
    there = F.array_compact(given)
    total = F.aggregate(there, F.lit(0), lambda a, x: a + x)
    major = F.when(total * 2 > F.size(there), 1).when(total * 2 < F.size(there), 0)
    full = F.size(there) == len(columns)
    votes = F.when(full, given)
    if fill_missing:
        votes = F.when(full, given).when(major.isNotNull(), F.transform(given, lambda v: F.coalesce(v, major)))
    return df.withColumn("missing", len(columns) - F.size(there)).withColumn("votes", votes)


def _agreement(n: Column, raters: int) -> list[Column]:
    ones = F.aggregate("votes", F.lit(0), lambda a, x: a + x).cast("double")
    zeros = F.lit(float(raters)) - ones
    return [((ones * ones + zeros * zeros - raters) / (raters * (raters - 1))), ones, n]


def kappa_by_bin(df: DataFrame, bin_column: str, columns: tuple[str, ...], fill_missing: bool = False) -> DataFrame:
    """Fleiss' and Randolph's kappa by bin, unanimous items, the majority with explicit ties; bins in order."""
    raters = len(columns)
    rows = votes_of(df, columns, fill_missing).where("votes is not null").withColumn("bin", F.regexp_replace(bin_column, r"1\.0\]", "1.0)"))
    each, ones, _ = _agreement(F.lit(1), raters)
    per = rows.groupBy("bin").agg(
        F.count("*").alias("items"),
        F.avg(each).alias("observed"),
        F.avg(ones / raters).alias("p1"),
        F.count_if(F.size(F.array_distinct("votes")) == 1).alias("unanimous"),
        F.count_if(ones / raters > 0.5).alias("toxic_items"),
    )
    p1 = F.col("p1")
    single = (p1 == 0) | (p1 == 1)
    fleiss_by_chance = p1 * p1 + (1 - p1) * (1 - p1)

    def kappa(chance: Column) -> Column:
        return F.when(single, 1.0).otherwise(F.round((F.col("observed") - chance) / (1 - chance), 4) + 0.0)

    toxic, clean = F.col("toxic_items"), F.col("items") - F.col("toxic_items")
    verdict = F.when(toxic > clean, "toxic").when(toxic < clean, "non-toxic").otherwise("tie")
    out = per.select("bin", "items", kappa(fleiss_by_chance).alias("kappa_fleiss"), kappa(F.lit(0.5)).alias("kappa_randolph"), single.alias("single_category"), "unanimous", "toxic_items", verdict.alias("majority"))
    return out.withColumn("lower", bin_floor(F.col("bin"))).orderBy("lower")


def agreement_report(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """One nested row: for each (language, model) its bins' kappas."""
    parts = [t.withColumn("language", F.lit(lang)).withColumn("model", F.lit(model)) for (lang, model), t in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    cells = every.groupBy("language", "model").agg(F.array_sort(F.collect_list(F.struct("lower", "bin", "items", "kappa_fleiss", "kappa_randolph", "unanimous", "majority"))).alias("bins"))
    return cells.agg(F.array_sort(F.collect_list(F.struct("language", "model", "bins"))).alias("tables"))


def missing_votes(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return votes_of(df, columns).agg(F.sum("missing").alias("missing_votes"))
