"""Sections of growing daily logs, appended to a memory log as they are finished."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.memory import MemoryLog
from ..plans import etl
from ..session import ship
from ..sources.live import LiveLogs


def sync_stream(log: MemoryLog, folder: str, tag: str = "daily-log") -> StreamingQuery:
    """Appends the sections that were finished in the logs of a folder since it ran last, each once, also after a restart: a batch that is retried replaces its own append."""
    spark = log.spark
    ship(spark)
    spark.dataSource.register(LiveLogs)
    parts = spark.readStream.format("live_logs").option("folder", folder).load()

    def put(batch: DataFrame, number: int) -> None:
        rows = etl.experiences(etl.section_fields(batch.orderBy("date", "at")), tag)
        log.append(etl.as_entries(rows, "episodic", "experience"), F.current_timestamp(), name=f"sync-{number:012d}")

    return parts.writeStream.foreachBatch(put).option("checkpointLocation", f"{log.root}/sync").trigger(availableNow=True).start()
