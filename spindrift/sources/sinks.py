"""Writers: tables, reports, and stage tables that resume."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _hadoop_write(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()


def write_report(spark: SparkSession, report: DataFrame, path: str) -> None:
    """A one-row nested report as one JSON file."""
    row = report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    _hadoop_write(spark, path, json.dumps(json.loads(row["j"]), indent=2, ensure_ascii=False).encode())


def write_csv_with_bom(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as one CSV file with a byte order mark; over ``most`` rows it is an error."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write_csv is for those")
    _hadoop_write(df.sparkSession, path, b"\xef\xbb\xbf" + rows.to_csv(index=False).encode())


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the table at ``path`` does not hold; returns them."""
    spark = df.sparkSession
    try:
        fresh = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df
    fresh.write.mode("append").parquet(path)
    return fresh


def patch_matching(df: DataFrame, text: str, pattern: str, column: str, value: F.Column) -> DataFrame:
    """``column`` anew where the text matches (without regard to case); written to another path, then swapped by the caller."""
    return df.withColumn(column, F.when(F.coalesce(F.col(text).rlike(f"(?iu){pattern}"), F.lit(False)), value).otherwise(F.col(column)))


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def resume_stage(spark: SparkSession, path: str, config: dict, make) -> DataFrame:
    """The stage table at ``path`` if it was made under ``config``; made now if missing; another configuration is an error."""
    digest = config_digest(config)
    try:
        done = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        make().withColumn("config_digest", F.lit(digest)).write.parquet(path)
        done = spark.read.parquet(path)
    if done.where(F.col("config_digest") != digest).limit(1).count():
        raise ValueError(f"{path} was made under another configuration")
    return done.drop("config_digest")


def log_run(spark: SparkSession, path: str, run: str, values: dict[str, float | str]) -> None:
    """Parameters and metrics of a run, appended to a table."""
    rows = [(run, k, None if isinstance(v, str) else float(v), str(v)) for k, v in sorted(values.items())]
    spark.createDataFrame(rows, "run string, name string, value double, text string").write.mode("append").parquet(path)
