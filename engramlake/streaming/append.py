"""The log's streaming front end: lines of files that arrive by tier and file are parsed and appended, each once. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import jsonl


def entries_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of files that arrive in ``<folder>/tier=<tier>/file=<file>/``."""
    lines = spark.readStream.schema("value string, tier string, file string").text(folder)
    return jsonl.parse(lines.select(F.col("value").alias("line"), "tier", "file", F.lit(0).cast("long").alias("line_no")))


def append_stream(spark: SparkSession, folder: str, root: str) -> StreamingQuery:
    """Appends to ``<root>/stream`` what is there and stops; run again for what came since. A batch that is retried replaces its own files."""
    root = root.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        batch.drop("line_no").write.mode("overwrite").partitionBy("tier", "file").parquet(f"{root}/stream/batch={number}")

    return entries_stream(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


def streamed(spark: SparkSession, root: str) -> DataFrame:
    """The entries that the stream appended."""
    return spark.read.parquet(f"{root.rstrip('/')}/stream")
