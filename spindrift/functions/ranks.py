"""Running totals and average ranks over whole columns without a single-task window.

Distinct values are dealt by range to partitions; each partition's total gives the offsets (a row
a partition), and the running total within a partition is a window over that partition alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.stage import Stages


def running_totals(df: DataFrame, order: str, values: list[str], by: tuple[str, ...] = (), descending: bool = False, stages: Stages | None = None) -> DataFrame:
    """``df`` (one row for each value of ``order``, within ``by``) with before_<v> and through_<v>, sums up to the row."""
    stages = stages or Stages(df.sparkSession, "ranks")
    key: Column = F.col(order).desc() if descending else F.col(order).asc()
    dealt = stages.save(df.repartitionByRange(*[F.col(c) for c in by], key).withColumn("_part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    above = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = above.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{v}").over(above), F.lit(0)).alias(f"_base_{v}") for v in values])
    inside = Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(sums, [*by, "_part"]) if by else dealt.join(sums, "_part")
    for v in values:
        out = out.withColumn(f"through_{v}", F.col(f"_base_{v}") + F.sum(v).over(inside)).withColumn(f"before_{v}", F.col(f"through_{v}") - F.col(v))
    return out.drop("_part", *[f"_base_{v}" for v in values])


def average_ranks(df: DataFrame, column: str, by: tuple[str, ...] = (), stages: Stages | None = None) -> DataFrame:
    """(by, value, n, rank): the average rank of each distinct value, from 1."""
    counts = df.groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    out = running_totals(counts, "value", ["n"], by, stages=stages)
    return out.select(*by, "value", "n", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))
