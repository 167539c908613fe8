"""Weights by a stream: outcomes arrive as files, are ordered by seq for each entry id, and only what they touch is worked out.

The state holds which outcomes (tier, id, seq) have come. Repeated ones change nothing; new ones go to the log's table
``outcomes``, from which late ones take their place, and the order of scores is folded into the weights of the entries with that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import memory
from ..session import few, written

OUTCOME = "tier string, id string, task_score double, seq long, at string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_outcomes(events: DataFrame) -> DataFrame:
    """The outcomes of a stream that haven't come before; of one seq of an id the first that came holds."""
    return events.dropDuplicates(["tier", "id", "seq"])


def weights_stream(log: memory.MemoryLog, folder: str) -> StreamingQuery:
    """Takes in the outcomes (Parquet files of OUTCOME) that have come to a folder since it ran last, and writes the entries that they change to the log. A batch that is retried writes the same again."""
    spark: SparkSession = log.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def put(batch: DataFrame, number: int) -> None:
        new = written(batch)  # the batch is worked out once
        if new.isEmpty():
            return
        log.tables.put(new, "outcomes", append=f"{number:017d}")
        every = log.tables.read("outcomes", OUTCOME).join(few(new.select("tier", "id").distinct()), ["tier", "id"], "left_semi")
        log.put_changed(memory.in_order(every))

    events = spark.readStream.schema(OUTCOME).parquet(folder)
    return new_outcomes(events).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{log.root}/progress").trigger(availableNow=True).start()
