"""Tables that any number of writers append to at once, on any file system, and snapshots of their latest rows.

An append has a folder of its own, named by time and a random part, so that no two meet and none looks
for the others; it counts once its job is committed. A snapshot holds the latest row of each key and the
appends that it covers: what came since, or was written meanwhile, is taken on top.
"""

from __future__ import annotations

import threading
import time
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few, written

_LOCK, _LAST = threading.Lock(), [0]


def stamp() -> str:
    """A name that sorts by time, later than those that this process took before; of other processes' by their clocks. No two are equal."""
    with _LOCK:
        _LAST[0] = max(time.time_ns() // 1000, _LAST[0] + 1)
        return f"{_LAST[0]:017d}-{uuid.uuid4().hex[:16]}"


class Tables:
    """Tables below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def files(self, name: str) -> tuple[JavaObject, JavaObject]:
        """The file system and path of a table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _done(self, name: str, pattern: str) -> list[str]:
        """The folders of a table, by name, whose jobs are committed."""
        fs, _ = self.files(name)
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{pattern}/_SUCCESS"))
        return sorted(x.getPath().getParent().getName() for x in found or [])

    def appends(self, name: str) -> list[str]:
        """The appends of a table that are done, in order."""
        return [x.removeprefix("append=") for x in self._done(name, "append=*")]

    def put(self, rows: DataFrame, name: str, *by: str, append: str | None = None) -> str:
        """Appends rows to a table and returns the append's name. One that is given and there already is replaced: a retried batch writes its own again."""
        mode, append = ("overwrite", append) if append else ("error", stamp())
        rows.write.mode(mode).partitionBy(*by).parquet(f"{self.root}/{name}/append={append}")
        return append

    def read(self, name: str, schema: str, only: list[str] | None = None) -> DataFrame:
        """The rows of all appends that are done, or of these, with ``append``; an empty frame if there are none."""
        full = f"{schema}, append string"
        chosen = self.appends(name) if only is None else only
        if not chosen:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/append={a}" for a in chosen])

    # --- latest rows

    def _base(self, name: str) -> tuple[str, list[str]] | None:
        """The last snapshot of a table that is done, and the appends it covers."""
        found = self._done(f"base/{name}", "covered=*")  # written after the rows
        if not found:
            return None
        at = found[-1].removeprefix("covered=")
        return f"{self.root}/base/{name}/rows={at}", [r["append"] for r in self.spark.read.schema("append string").parquet(f"{self.root}/base/{name}/covered={at}").collect()]

    def latest(self, name: str, schema: str, key: str) -> DataFrame:
        """The last row of each key by append and ``seq`` (which the schema has), with both as seq.

        Of what the last snapshot covers nothing is worked out again: its rows are scanned as they are, less the
        keys that came since.
        """
        base = self._base(name)
        if base is None:
            return _latest(self.read(name, schema), key)
        at, covered = base
        kept = self.spark.read.schema(_with_place(schema)).parquet(at)
        fresh = sorted(set(self.appends(name)) - set(covered))
        if not fresh:
            return kept
        new = written(_latest(self.read(name, schema, fresh), key))
        return kept.join(few(new.select(key)), key, "left_anti").unionByName(new)

    def compact(self, name: str, schema: str, key: str) -> None:
        """Makes a snapshot of the latest rows. Appends go on meanwhile: those that aren't covered are found by name, whenever they began."""
        at, covered = stamp(), self.appends(name)
        base = self._base(name)
        old = base[1] if base else []
        fresh = sorted(set(covered) - set(old))
        new = _latest(self.read(name, schema, fresh), key)
        if base:
            new = written(new)
            kept = self.spark.read.schema(_with_place(schema)).parquet(base[0])
            new = kept.join(few(new.select(key)), key, "left_anti").unionByName(new)
        new.write.parquet(f"{self.root}/base/{name}/rows={at}")
        self.spark.createDataFrame([(a,) for a in sorted({*covered, *old})], "append string").coalesce(1).write.parquet(f"{self.root}/base/{name}/covered={at}")


def _with_place(schema: str) -> str:
    """A table's schema with the place of a row, as snapshots hold it."""
    return ", ".join("seq struct<append: string, seq: bigint>" if c.strip().startswith("seq ") else c for c in schema.split(", "))


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key by append and seq: what was replaced is found by numbers, and no wide column is moved."""
    place = F.struct("append", "seq")
    again = written(rows.groupBy(key).agg(F.max(place).alias("_last"), F.count("*").alias("_n")).filter("_n > 1"))
    if not again.isEmpty():
        old = rows.select(key, "append", "seq").join(few(again), key).filter(place < F.col("_last")).select("append", "seq")
        rows = rows.join(few(old), ["append", "seq"], "left_anti")
    return rows.withColumn("seq", place).drop("append")
