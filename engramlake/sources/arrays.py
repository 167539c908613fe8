"""JSON arrays in files of any size, read by splits.

A file is cut at every closing brace, as other files are at line feeds, so it is split as any text file is.
Whether such a fragment begins within a string, and how deep, follows from those before it: quotes
that aren't escaped are counted by fragment, by split and by file, then braces and brackets outside strings
are. An element ends with a brace at the array's own depth that is in no string; what lies between two
such ends is parsed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written


def _before(rows: DataFrame, value: str) -> DataFrame:
    """rows (path, at: the split's place, row: the number within all) with ``before``: the sum of ``value`` over the file's fragments before each. One row for each split meets those of its file."""
    own = Window.partitionBy("path", "at").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "at").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inner = rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inner.join(splits, ["path", "at"]).withColumn("before", F.col("_base") + F.col("_own")).drop("_base", "_own")


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _opened(text: Column) -> Column:
    """By how much braces and brackets outside strings go deeper: without whole strings and one that is open at the end."""
    outside = F.regexp_replace(text, '"[^"]*+(?:"|$)', "")
    return F.aggregate(F.array(outside), F.lit(0), lambda n, x: n + _count(x, "[{") - _count(x, "]}"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """path and ``raw``, each element of the JSON array of each file as text.

    Elements may be of any kind; braces, brackets, quotes and escapes in strings are no borders. An empty
    array gives no rows, and so does a file without one; null elements are rows with a null. Elements come
    in no order. A file may be of any size, an element as large as a value may be. Only
    numbers are kept for each fragment; the text moves once to its element.
    """
    cut = spark.read.option("lineSep", "}").text(path)
    rows = cut.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value")
    bare = F.regexp_replace("value", r"\\(?s:.)", "")  # an escaped brace isn't JSON, so no escape is cut
    rows = rows.select("*", F.inline(F.array(F.struct(bare.alias("bare")))))
    rows = written(rows.select("path", "at", "row", "value", _count(F.col("bare"), '"').alias("quotes"), _opened(F.col("bare")).alias("opened"), _opened(F.concat(F.lit('"'), "bare")).alias("opened_inside")))
    numbers = _before(rows.drop("value"), "quotes")
    inside = F.col("before") % 2 == 1
    brace = (F.col("before") + F.col("quotes")) % 2 == 0  # the one at the fragment's end is in no string
    change = F.when(inside, F.col("opened_inside")).otherwise(F.col("opened")) - brace.cast("int")
    numbers = _before(written(numbers.select("path", "at", "row", brace.alias("brace"), change.alias("change"))), "change")
    ends = F.col("brace") & (F.col("before") + F.col("change") == 1)
    numbers = _before(written(numbers.select("path", "at", "row", ends.cast("int").alias("ends"))), "ends")
    rows = rows.select("path", "at", "row", "value").join(numbers.select("row", "ends", F.col("before").alias("element")), "row")
    last = Window.partitionBy("path")
    parts = rows.groupBy("path", "element").agg(F.array_sort(F.collect_list(F.struct("at", "row", "value"))).alias("parts"), F.max("ends").alias("closed"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "}")
    whole = parts.select("path", "element", "closed", F.inline(F.array(F.struct(text.alias("text"))))).withColumn("top", F.max("element").over(last))
    # between the borders: what stands before an element's comma, and the array's own brackets, go
    inner = F.regexp_replace("text", r"^[\s﻿]*+,", "")
    inner = F.when(F.col("element") == 0, F.regexp_replace(inner, r"^[\s﻿]*+\[", "")).otherwise(inner)
    inner = F.when(F.col("closed") == 1, F.concat(inner, F.lit("}"))).otherwise(F.regexp_replace(inner, r"\][\s]*+$", ""))
    items = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>")
    return whole.filter(F.length(F.btrim(inner, F.lit(" \t\r\n"))) > 0).select("path", F.explode(items).alias("raw"))
