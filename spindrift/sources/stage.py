"""Written stage tables: lineage ends at a Parquet table every executor can read."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that every executor of {master} can read")
        found = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stages:
    """Stage tables of one run, each under a path of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; the returned frame has no lineage but the files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        schema = df.schema
        # Small Arrow batches bound what executors hold outside of their heap and in their Python workers.
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(BATCH, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._stage_path = path
        del df
        self.release()
        return out

    def release(self) -> None:
        """Let go of the shuffle files of what is written: Spark deletes them when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if getattr(df, "_stage_path", None):
                path = jvm.org.apache.hadoop.fs.Path(df._stage_path)
                path.getFileSystem(conf).delete(path, True)
