"""Cutting lineage between the rounds of iterative operators, tables in the shared folder, and batches of bounded size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); removed when the JVM ends."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(folder or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = new_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the rows that go to a Python worker at once.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let rows of pages or files go to Python workers in batches of BATCH_BYTES from now on in this session, not of 10,000 rows whatever their size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
