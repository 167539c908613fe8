"""The driver's tables in the shape of the data model: entries, documents at three levels, queries, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as E
from .operators import ingest

NOW = "2024-02-15 00:00:00+00:00"
#: Tier and entry type of each event type.
EVENT_KINDS = {"error": ("episodic", "failure"), "purchase": ("episodic", "decision"), "view": ("episodic", "experience"), "signup": ("semantic", "fact"), "click": ("procedural", "skill")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def _by_kind(i: int) -> F.Column:
    return E.lookup({k: v[i] for k, v in EVENT_KINDS.items()}, F.col("event_type"))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries from events: times of even ids with an offset, of odd ids without; every 97th without a time."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", "event_type", "user_id", "props", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("")).alias("t"), _by_kind(0).alias("e_tier"), _by_kind(1).alias("e_type"))
    rows = rows.withColumn("file", E.route(F.col("e_tier"), F.col("e_type"))).withColumn("weight", E.initial_weight(F.lit(None).cast("double"), F.col("e_type")))
    ts = F.when(F.col("event_id") % 97 != 0, F.col("t"))
    raw = F.concat(
        F.lit('{"id": "evt-'), F.col("event_id").cast("string"), F.lit('", '), F.when(ts.isNotNull(), F.concat(F.lit('"ts": "'), ts, F.lit('", '))).otherwise(""), F.lit('"title": "'), F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"),
        F.lit('", "props": '), F.col("props"), F.lit(', "tags": [], "weight": '), F.col("weight").cast("string"), F.lit(', "_tier": "'), F.col("e_tier"), F.lit('", "_type": "'), F.col("e_type"), F.lit('"}'),
    )
    # built once: filters on the line aren't pushed below a generator
    lines = rows.withColumn("ts_text", ts).select("*", F.inline(F.array(F.struct(raw.alias("raw")))))
    return lines.select(F.col("e_tier").alias("tier"), "file", F.col("event_id").alias("line_no"), "raw", F.lower("raw").alias("raw_lc"), F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("id"), F.col("ts_text").alias("ts"), "weight", "e_tier", "e_type", "user_id", "event_id")


def document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abstract, overview and token counts; the full text is a table of its own (``document_texts``)."""
    d = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source")
    l0, l1 = E.fallback_abstract(title, F.col("text")), F.when(F.col("doc_id") % 5 == 0, "").otherwise(ingest.extractive(title, path, F.lit("reference"), F.col("text"))[1])
    rows = d.select("doc_id", title.alias("title"), path.alias("hierarchy_path"), l0.alias("l0_abstract"), l1.alias("l1_overview"), E.tokens(F.col("text")).alias("l2_tokens"))
    return rows.select("*", E.tokens(F.col("l0_abstract")).alias("l0_tokens"), E.tokens(F.col("l1_overview")).alias("l1_tokens"), E.l2_path(F.col("hierarchy_path"), F.col("title")).alias("l2_file_path"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts by path; every seventh is missing."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0")
    return d.select(E.l2_path(F.concat(F.lit("/"), "lang", F.lit("/"), "source"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).alias("l2_file_path"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return e.withColumn("norm", E.norm(F.col("embedding")))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all, with budgets, agents and, for every third, a directory."""
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    budget = F.element_at(F.array(F.lit(1000), F.lit(4000), F.lit(20000)), (F.col("vec_id") % 3 + 1).cast("int"))
    return q.select(F.col("vec_id").alias("query_id"), "embedding", budget.alias("token_budget"), F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("query_text"), F.lit("agent").alias("agent_id"), F.when(F.col("vec_id") % 3 == 0, "/en").alias("directory"))


def episode_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of episodes from documents: metadata with null, absent and present keys."""
    d = table(spark, sf_dir, "documents")
    meta = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"source": "'), "source", F.lit('"}'))).when(F.col("doc_id") % 3 == 1, F.lit('{"source": null}')).otherwise(F.lit("{}"))
    epi = F.concat(F.lit('{"source": "lang-'), "lang", F.lit('", "importance": 0.25, "outcome": "ok"}'))
    return d.select(F.concat(F.lit("ep-"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")).alias("document"), meta.alias("metadata"), epi.alias("episode"), "doc_id")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with validity from orders: finished ones are invalidated."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("placed").alias("predicate"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("object"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.lit(None).cast("string").alias("valid_to"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("invalidated_at"),
    )


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown log for each conversation: a section for each turn."""
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("\n\n## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "").alias("body"))
    return rows.select(F.col("conv_id").cast("string").alias("date"), F.concat(F.lit("# "), F.col("conv_id").cast("string"), "body").alias("content"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes from labels for the events of their ids, three in order."""
    lab = table(spark, sf_dir, "labels")
    steps = F.array(F.when(F.col("toxic") == 1, 0.1).otherwise(0.5), F.when(F.col("quality") == 1, 0.9).otherwise(0.5), F.col("doc_id") % 11 / F.lit(10.0))
    return lab.select(F.concat(F.lit("evt-"), F.col("doc_id").cast("string")).alias("id"), F.posexplode(steps).alias("seq", "task_score"))


def memory_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The entries as JSON-lines files of a folder, one for each tier and file, after a header."""
    e = event_entries(spark, sf_dir)
    head = e.select("tier", "file").distinct().select("tier", "file", F.lit(-1).cast("long").alias("line_no"), F.lit('{"schema": "header"}').alias("value"))
    rows = e.select("tier", "file", "line_no", F.col("raw").alias("value")).union(head)
    named = rows.select(F.concat_ws(".", "tier", "file").alias("name"), "line_no", "value").repartition("name").sortWithinPartitions("name", "line_no")
    _named(spark, named.select("name", "value"), root, lambda name: name.replace(".", "/") + ".jsonl")


def text_files(spark: SparkSession, rows: DataFrame, root: str, ending: str) -> None:
    """A file for each row (name, value) of a small table: below ``root/files``."""
    _named(spark, rows.select("name", "value").repartition("name"), root, lambda name: name + ending)


def _named(spark: SparkSession, rows: DataFrame, root: str, path_of: Callable[[str], str]) -> None:
    """Writes the lines (value) of each name, which lie in one partition, to a file of that name; there are few names."""
    rows.write.partitionBy("name").text(f"{root}/parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for part in fs.globStatus(hadoop.Path(f"{root}/parts/name=*/part-*")):
        to = hadoop.Path(f"{root}/files/{path_of(part.getPath().getParent().getName().removeprefix('name='))}")
        fs.mkdirs(to.getParent())
        fs.rename(part.getPath(), to)
