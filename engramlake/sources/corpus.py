"""Other sources: Markdown corpora, dated logs, JSON exports, fact tables, directory trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import title_case
from .arrays import json_array


def markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """stem, title and content of every file of a folder."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("stem"), F.col("value").alias("content"))
    return files.select("stem", title_case(F.col("stem")).alias("title"), "content")


def dated_logs(spark: SparkSession, folder: str) -> DataFrame:
    """date and content of files named by a date."""
    return markdown(spark, folder, "????-??-??.md").select(F.col("stem").alias("date"), "content")


def json_export(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of files that hold a JSON array each, as text columns ``raw`` so that absent and null keys stay apart, or by a schema. A file may be of any size; see ``arrays.json_array``."""
    raw = json_array(spark, path).select("raw")
    return raw.select(F.from_json("raw", schema).alias("_x")).select("_x.*") if schema else raw


def current_facts(facts: DataFrame) -> DataFrame:
    """Facts that are neither ended nor invalidated; the filter reaches the source."""
    return facts.filter(F.col("valid_to").isNull() & F.col("invalidated_at").isNull())


def browse(paths: DataFrame, path: str = "") -> DataFrame:
    """exists, directories and files (name-sorted) right below a path, given a column ``path`` of files.

    One row; a path with ``..`` is an error.
    """
    if ".." in path.split("/"):
        raise ValueError("a path must not leave its tree")
    base = path.strip("/")
    inside = paths.select(F.btrim("path", F.lit("/")).alias("p"))
    if base:
        inside = inside.filter(F.startswith("p", F.lit(base + "/"))).select(F.substr("p", F.lit(len(base) + 2)).alias("p"))
    names = inside.select(F.substring_index("p", "/", 1).alias("name"), F.contains("p", F.lit("/")).alias("is_dir")).distinct()
    got = names.groupBy().agg(F.array_sort(F.collect_set(F.when(F.col("is_dir"), F.col("name")))).alias("directories"), F.array_sort(F.collect_set(F.when(~F.col("is_dir"), F.col("name")))).alias("files"))
    return got.select(F.lit(base).alias("path"), ((F.size("directories") > 0) | (F.size("files") > 0)).alias("exists"), "directories", "files")
