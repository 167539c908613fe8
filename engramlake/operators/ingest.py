"""Ingestion of documents at three resolutions, and the store that holds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..model import DOC_TYPES, DOCUMENT, L0_INPUT, L0_WORDS, L1_INPUT, L1_OUTPUT
from . import disclosure
from .tables import Tables, stamp
from .vectors import VectorIndex

#: A summariser gives abstract and overview columns of (title, hierarchy_path, doc_type, content); plug a model in as a pandas UDF.
Summariser = Callable[[Column, Column, Column, Column], tuple[Column, Column]]


def render_prompt(level: str, title: Column, path: Column, doc_type: Column, content: Column) -> Column:
    """What a summariser model is asked: an abstract (l0) or an overview (l1) of the text, cut to the model's input."""
    task, n = {"l0": ("State in one sentence what this document is about, what it concludes and what sets it apart.", L0_INPUT), "l1": ("Write a dense overview in Markdown: purpose, key points, metrics, relations, use.", L1_INPUT)}[level]
    return F.concat(F.lit(f"{task}\nType: "), doc_type, F.lit("\nPath: "), path, F.lit("\nTitle: "), title, F.lit("\n\n"), F.substring(content, 1, n))


def extractive(title: Column, path: Column, doc_type: Column, content: Column) -> tuple[Column, Column]:
    """The default summariser, without a model: no abstract of its own (the fallback stands in), and as overview headings and first sentences.

    An overview ends at 4 x L1_OUTPUT characters, the most tokens that a model is asked for, be that within a section. ``central.central`` is another one.
    """
    return F.lit(""), F.substring(E.extract(title, content), 1, 4 * L1_OUTPUT)


def prompted(model: Callable[[Column], Column]) -> Summariser:
    """A summariser that asks a model: a function of a column of prompts, such as a pandas UDF."""
    return lambda *parts: (model(render_prompt("l0", *parts)), model(render_prompt("l1", *parts)))


def _key(docs: DataFrame) -> Column:
    return F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.sha2(F.concat_ws("|", "hierarchy_path", "title", "content"), 256)


def document_columns(docs: DataFrame, summariser: Summariser = extractive, now: Column | None = None) -> DataFrame:
    """The document table's columns for title, content, hierarchy_path, doc_type, tags and, if there, doc_id.

    What a summariser says is stripped, and so are its <think> parts; ``extractive`` takes the document's own words, which stay as it cuts
    them. An abstract of under L0_WORDS words becomes the title with the text's beginning. An unknown doc_type is an error, before anything is written.
    """
    title, path, kind, content = (F.col(c) for c in ("title", "hierarchy_path", "doc_type", "content"))
    l0, l1 = (c if summariser is extractive else E.unthink(c) for c in summariser(title, path, kind, content))
    l0 = F.when(E.word_count(l0) < L0_WORDS, E.fallback_abstract(title, content)).otherwise(l0)
    stamp = F.lit(None).cast("string") if now is None else F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = docs.withColumns({"_l0": l0, "_l1": l1})
    return rows.select(
        _key(docs).alias("doc_id"),
        path.alias("hierarchy_path"),
        title.alias("title"),
        F.when(kind.isin(*DOC_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown doc_type: "), kind))).alias("doc_type"),
        F.col("_l0").alias("l0_abstract"),
        E.tokens(F.col("_l0")).alias("l0_token_count"),
        F.col("_l1").alias("l1_overview"),
        E.tokens(F.col("_l1")).alias("l1_token_count"),
        E.l2_path(path, title).alias("l2_file_path"),
        E.tokens(content).alias("l2_token_count"),
        F.sha2(content, 256).alias("l2_checksum"),
        E.parent_path(path).alias("parent_path"),
        E.depth(path).alias("depth"),
        F.col("tags"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        F.lit(False).alias("is_stale"),
        F.lit(None).cast("string").alias("stale_reason"),
        F.lit("manual").alias("source_type"),
        F.lit(None).cast("string").alias("cortex_tier"),
        F.monotonically_increasing_id().alias("seq"),
    )


def latest(rows: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The last row of each key: insert or replace."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stale(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """Documents whose full text no longer has their checksum, with is_stale and stale_reason set."""
    now = contents.select("l2_file_path", F.sha2("content", 256).alias("_now"))
    rows = documents.join(now, "l2_file_path").filter("_now <> l2_checksum")
    return rows.withColumns({"is_stale": F.lit(True), "stale_reason": F.lit("content changed")}).drop("_now")


def corpus_totals(documents: DataFrame) -> DataFrame:
    """Documents and tokens by level, and the abstracts' and overviews' share of the full texts in percent."""
    s = documents.agg(F.count("*").alias("documents"), *(F.sum(f"l{i}_token_count").cast("long").alias(f"l{i}_total") for i in range(3)))
    return s.select("*", *(E.half_up(100.0 * F.col(f"l{i}_total") / F.col("l2_total")).alias(f"l{i}_percent") for i in range(2)), E.half_up(100.0 * (1 - F.col("l0_total") / F.col("l2_total"))).alias("reduction_percent"))


def directories(documents: DataFrame) -> DataFrame:
    """path, parent_path, name and doc_count of every directory that holds documents."""
    rows = documents.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("doc_count"))
    return rows.select("path", E.parent_path(F.col("path")).alias("parent_path"), F.element_at(F.split("path", "/"), -1).alias("name"), "doc_count")


class DocumentStore:
    """Documents below a folder: ``documents`` (rows by append and seq; the last of an id counts), ``l2`` (full texts by path), ``vectors`` (by id), ``query_log``, and snapshots (``base``) of the first three."""

    def __init__(self, spark: SparkSession, root: str, summariser: Summariser = extractive) -> None:
        self.spark, self.root, self.summariser = spark, root.rstrip("/"), summariser
        self.tables = Tables(spark, root)

    def _schema(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOCUMENT)

    def create(self) -> DocumentStore:
        """Makes the tables that aren't there, without rows."""
        for name, schema in (("documents", self._schema()), ("l2", self.L2), ("vectors", self.VECTORS), ("query_log", self.LOG)):
            fs, path = self.tables.files(name)
            if not fs.exists(path):
                self.tables.put(self.spark.createDataFrame([], schema), name)
        return self

    L2 = "l2_file_path string, content string, seq long"
    VECTORS = "doc_id string, embedding array<double>, norm double, seq long"
    LOG = "query_id string, step int, query_text string, agent_id string, l0_results long, l1_expansions long, l2_loads long, total_tokens long"

    def documents(self) -> DataFrame:
        return self.tables.latest("documents", self._schema(), "doc_id")

    def contents(self) -> DataFrame:
        """l2_file_path and content, the last of each path."""
        return self.tables.latest("l2", self.L2, "l2_file_path").drop("seq")

    def vectors(self) -> DataFrame:
        """doc_id, embedding and norm of each document that was ingested with an embedding."""
        return self.tables.latest("vectors", self.VECTORS, "doc_id").drop("seq")

    def _append(self, docs: DataFrame, rows: DataFrame) -> None:
        n, seq = stamp(), F.monotonically_increasing_id()
        self.tables.put(rows.withColumn("seq", seq), "documents", append=n)
        self.tables.put(docs.select(E.l2_path(F.col("hierarchy_path"), F.col("title")).alias("l2_file_path"), "content", seq.alias("seq")), "l2", append=n)
        if "embedding" in docs.columns:
            vectors = docs.select(_key(docs).alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), seq.alias("seq")).filter("embedding IS NOT NULL")
            self.tables.put(disclosure.with_norms(vectors), "vectors", append=n)

    def ingest(self, docs: DataFrame, now: Column | None = None) -> DataFrame:
        """Adds documents, with their vectors if there is a column ``embedding``, and returns doc_id, token counts and the reduction in percent. Equal path and title share a full text."""
        rows = document_columns(docs, self.summariser, now)
        self._append(docs, rows)
        return rows.select("doc_id", F.col("l0_token_count").alias("l0_tokens"), F.col("l1_token_count").alias("l1_tokens"), F.col("l2_token_count").alias("l2_tokens"), E.half_up(E.reduction_percent(F.col("l0_token_count"), F.col("l1_token_count"), F.col("l2_token_count")), 1).alias("reduction_percent"))

    def regenerate(self, doc_ids: list[str] | DataFrame) -> int:
        """Makes abstract, overview, counts and checksum anew from the full text and clears staleness; updated_at stays. The number of documents done.

        doc_ids: a list, or a frame with doc_id.
        """
        rows = self.documents()
        asked = rows.filter(F.col("doc_id").isin(doc_ids)) if isinstance(doc_ids, list) else rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        old = asked.join(self.contents(), "l2_file_path")
        new = document_columns(old, self.summariser).drop("created_at", "updated_at", "seq").join(old.select("doc_id", "created_at", "updated_at", "seq"), "doc_id")
        rows = new.select(*[c.split()[0] for c in self._schema().split(", ")])
        n = rows.count()
        self.tables.put(rows.withColumn("seq", F.monotonically_increasing_id()), "documents")
        return n

    def mark_stale(self) -> int:
        """Writes what ``stale`` finds; the number of documents."""
        rows = stale(self.documents(), self.contents()).select(*[c.split()[0] for c in self._schema().split(", ")])
        n = rows.count()
        self.tables.put(rows.withColumn("seq", F.monotonically_increasing_id()), "documents")
        return n

    def _levels(self) -> DataFrame:
        return self.documents().select("doc_id", "title", "hierarchy_path", "l0_abstract", F.col("l0_token_count").alias("l0_tokens"), "l1_overview", F.col("l1_token_count").alias("l1_tokens"), "l2_file_path", F.col("l2_token_count").alias("l2_tokens"))

    def compact(self) -> None:
        """Makes snapshots of the latest documents, texts and vectors, so that reading them works nothing out. Ingestion may go on meanwhile."""
        for name, schema, key in (("documents", self._schema(), "doc_id"), ("l2", self.L2, "l2_file_path"), ("vectors", self.VECTORS, "doc_id")):
            self.tables.compact(name, schema, key)

    def index(self, cells: int | None = None) -> VectorIndex:
        """An index of the vectors as they are now, for ``smart_query``."""
        known = self.vectors().select("doc_id", "embedding").join(self.documents().select("doc_id", "hierarchy_path"), "doc_id")
        return VectorIndex(self.spark, f"{self.root}/index/{stamp()}").build(known, cells)

    def smart_query(self, vectors: DataFrame | None, queries: DataFrame, index: VectorIndex | None = None, exact: bool = False, **options: object) -> DataFrame:
        """See ``disclosure.smart_query``, by these vectors, by an index (with exact: whose results are those of a full search) or by the stored ones; queries also hold query_text and agent_id, and each run is logged."""
        hits = None
        if index is not None:
            hits = index.search(queries, exact=exact, **{k: v for k, v in options.items() if k in ("top_k", "directory", "stretch")})
            known = None
        else:
            known = self.vectors() if vectors is None else disclosure.with_norms(vectors)
            if options.get("directory"):
                known = known.join(self.documents().select("doc_id", "hierarchy_path"), "doc_id")
        out = disclosure.smart_query(known, self._levels(), self.contents(), queries, hits=hits, **options)
        if {"query_text", "agent_id"} <= set(queries.columns):
            log = disclosure.query_log(out, queries)
            self.tables.put(log.withColumn("query_id", F.col("query_id").cast("string")), "query_log")
        return out

    def document_tier(self, doc_id: str, tier: str) -> DataFrame:
        return disclosure.document_tier(self._levels().filter(F.col("doc_id") == doc_id), self.contents(), F.lit(tier))

    def document(self, doc_id: str) -> DataFrame:
        return self.documents().filter(F.col("doc_id") == doc_id)

    def list_documents(self) -> DataFrame:
        return disclosure.list_documents(self.documents())

    def query_log(self) -> DataFrame:
        return self.tables.read("query_log", self.LOG).drop("append")
