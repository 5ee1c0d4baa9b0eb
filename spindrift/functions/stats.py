"""Statistics from their formulas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.ranks import average_ranks, running_totals


def _corr(a: str, b: str) -> Column:
    """``corr`` without its error on a constant column."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Pearson and Spearman correlation by group; null for under two rows or a constant column."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(by, a, b)
    guard = (F.count("*") >= 2) & (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    ra = average_ranks(pairs, a, (by,)).select(by, F.col("value").alias(a), F.col("rank").alias("rank_a"))
    rb = average_ranks(pairs, b, (by,)).select(by, F.col("value").alias(b), F.col("rank").alias("rank_b"))
    ranked = pairs.join(ra, [by, a]).join(rb, [by, b])
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"), F.when(guard, _corr(a, b)).alias("pearson"), F.when(guard, _corr("rank_a", "rank_b")).alias("spearman"),
        F.round(F.avg(a), 4).alias("mean_a"), F.round(F.stddev_samp(a), 4).alias("std_a"), F.round(F.avg(b), 4).alias("mean_b"), F.round(F.stddev_samp(b), 4).alias("std_b"),
    )


def binomial_tail_value(n: int, k: int, p: float) -> float:
    """P(X >= k) of a binomial, summed from logs."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    i = np.arange(k, n + 1)
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    terms = log_fact[n] - log_fact[i] - log_fact[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def _binomial_tail(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) or pd.isna(z) else binomial_tail_value(int(x), int(y), float(z)) for x, y, z in zip(n, k, p, strict=True)])


def with_binomial_tail(df: DataFrame, n: str, k: str, p: str, out: str) -> DataFrame:
    """P(X >= k) for each row, computed once for each distinct (n, k, p)."""
    cases = df.select(n, k, p).distinct().withColumn(out, F.pandas_udf(_binomial_tail, "double")(n, k, p))
    return df.join(cases, [n, k, p], "left")


def mann_whitney(df: DataFrame, value: str, group: str, by: str) -> DataFrame:
    """U of the rows where ``group`` is true, one-sided ("less") p by the tie-corrected normal with continuity, rank-biserial effect.

    A population where either group has under two rows gives nulls.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(by, value, group)
    ranked = rows.groupBy(by, F.col(value).alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col(group)).alias("n_in"))
    ranks = running_totals(ranked, "value", ["n"], (by,)).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2.0)
    per = ranks.groupBy(by).agg(
        F.sum("n_in").alias("n1"), F.sum(F.col("n") - F.col("n_in")).alias("n2"), F.sum(F.col("rank") * F.col("n_in")).alias("r1"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties")
    )
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    n = (n1 + n2).cast("double")
    var = n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    usable = (n1 >= 2) & (n2 >= 2)
    z = F.try_divide(u - n1 * n2 / 2.0 + 0.5, F.sqrt(var))
    return per.select(by, "n1", "n2", F.when(usable, u).alias("u"), F.when(usable, normal_cdf(z)).alias("p_less"), F.when(usable, 2 * u / (n1 * n2) - 1).alias("rank_biserial"))


def _normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(-x / math.sqrt(2)))


def normal_cdf(z: Column) -> Column:
    """Of the standard normal; rows here are few (one a population)."""
    return F.pandas_udf(_normal_cdf, "double")(z)


def average_precision(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise area under precision and recall; equal scores are one step."""
    steps = df.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    run = running_totals(steps, "s", ["n", "hits"], by, descending=True)
    got = run.withColumn("gain", F.col("hits") * F.col("through_hits") / F.col("through_n"))
    total = got.groupBy(*by) if by else got
    return total.agg(F.try_divide(F.sum("gain"), F.sum("hits").cast("double")).alias("average_precision"), F.sum("hits").alias("positives"), F.sum("n").alias("rows"))


def expected_stars(probabilities: Column) -> Column:
    """Sum of p_i * i over the classes 1, 2, ..."""
    return F.aggregate(F.transform(probabilities, lambda p, i: p * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
