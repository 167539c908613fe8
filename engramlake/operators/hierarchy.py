"""Paths as intervals: directories are numbered in pre-order, so a subtree is a range of numbers and every ancestor has totals.

A directory's number is its place among all directories in the order in which each is followed by what
is below it; its interval ends with its last descendant. Documents lie sorted by their directory's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import few, written


def clean_path(path: Column) -> Column:
    """A path with a slash before each name and none at the end; the root is empty."""
    p = F.btrim(F.regexp_replace(path, "/+", "/"), F.lit("/"))
    return F.when(p == "", "").otherwise(F.concat(F.lit("/"), p))


def ancestors(path: Column) -> Column:
    """The root, every directory above a clean path, and the path itself."""
    names = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/"))


def directories(documents: DataFrame) -> DataFrame:
    """path, parent, depth, documents and tokens (of whole texts) of every directory that has a document at or below it, with ``pre`` and ``last``, its interval of numbers.

    documents: hierarchy_path (null: the root) and l2_tokens. Each document counts once for each of its ancestors, first
    within a task, so that the root is no hot key.
    """
    rows = documents.select(clean_path(F.coalesce("hierarchy_path", F.lit(""))).alias("p"), F.coalesce("l2_tokens", F.lit(0)).cast("long").alias("t"))
    own = written(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("t").alias("t")))
    total = written(own.select(F.explode(ancestors(F.col("p"))).alias("path"), "n", "t").groupBy("path").agg(F.sum("n").alias("documents"), F.sum("t").alias("tokens")))
    below = total.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("size"))
    # a slash sorts before any other character of a name, so that a directory is followed by what is below it
    key = F.split("path", "/")
    sorted_ = written(total.join(below, "path").withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key").drop("key").withColumn("row", F.monotonically_increasing_id()))
    parts = sorted_.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("rows"))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    parts = parts.select("part", F.coalesce(F.sum("rows").over(first), F.lit(0)).alias("before"))
    numbered = sorted_.withColumn("part", F.shiftright("row", 33)).join(F.broadcast(parts), "part").withColumn("pre", F.col("before") + F.col("row").bitwiseAND(2**33 - 1))
    names = F.split("path", "/")
    parent = F.when(F.col("path") == "", None).otherwise(F.array_join(F.slice(names, 1, F.size(names) - 1), "/"))
    return numbered.select("path", parent.alias("parent"), (F.size(names) - 1).alias("depth"), "documents", "tokens", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))


class Hierarchy:
    """Documents below a folder by interval: ``directories`` and ``documents`` (sorted by ``pre``, their directory's number)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, documents: DataFrame) -> Hierarchy:
        """Writes both for documents (hierarchy_path, l2_tokens and any other columns)."""
        directories(documents).write.parquet(f"{self.root}/directories")
        numbers = self.directories().select(F.col("path").alias("_path"), "pre")
        rows = documents.withColumn("_path", clean_path(F.coalesce("hierarchy_path", F.lit("")))).join(few(numbers), "_path").drop("_path")
        # documents of one directory, of any number, lie over several tasks
        keys = ["pre", F.monotonically_increasing_id() % 64]
        rows.repartitionByRange(*keys).sortWithinPartitions("pre").write.parquet(f"{self.root}/documents")
        return self

    def directories(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/directories")

    def subtree(self, path: str) -> DataFrame:
        """The documents at or below a directory: a range of numbers, which the scan takes as a filter. A path that isn't there has none."""
        name = path.strip("/")
        row = self.directories().filter(F.col("path") == (f"/{name}" if name else "")).first()
        low, high = (row["pre"], row["last"]) if row else (0, -1)
        return self.spark.read.parquet(f"{self.root}/documents").filter((F.col("pre") >= low) & (F.col("pre") <= high))

    def children(self, path: str) -> DataFrame:
        """The directories right below one, with their totals, by name."""
        name = path.strip("/")
        return self.directories().filter(F.col("parent") == (f"/{name}" if name else "")).orderBy("path")
