"""Incremental language statistics of hosts over a stream of span files.

Progress lives in the checkpoint, so files that were done are not read again after
a restart; the sums by host and language are the state. The counts have no event
time, hence no watermark: the state grows with the hosts, as the batch result does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import url as U

SPANS = "uri string, language string, offset long, bytes long"


def span_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of spans as a stream."""
    return spark.readStream.schema(SPANS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def host_languages(spans: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Bytes by host and language, kept up to date."""
    kept = spans.where(F.col("bytes") >= min_bytes)
    return kept.groupBy(U.host(F.col("uri")).alias("host"), "language").agg(F.sum("bytes").alias("bytes"))


def run(spans: DataFrame, out: str, checkpoint: str, min_bytes: int = 100) -> StreamingQuery:
    """Write the whole statistics after each batch, replacing those before; ends when all files there are done."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return host_languages(spans, min_bytes).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replace).start()
