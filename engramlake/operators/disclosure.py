"""Tiered retrieval: cosine top-k over abstracts, then escalation to overviews and one full text within a token budget.

All queries of a batch are answered at once. What the escalation decides in turn has a closed form
of windows over a query's results in rank order, so the plan is one exchange on query_id; full
texts are joined last, for the rows that load one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..model import BUDGET, L1_CHARGE, L1_SCORE, L1_SLOTS, L2_SCORE, TOP_K, within
from ..session import few, ship, written
from . import best
from .memory import QUERY_BLOCK, query_blocks

#: Numbers in the vectors of the queries that a scan answers.
NUMBERS = 1 << 20


def _windows() -> tuple[WindowSpec, WindowSpec]:
    """A query's results, and those in rank order."""
    q = Window.partitionBy("query_id")
    return q, q.orderBy("rank")


def with_norms(vectors: DataFrame) -> DataFrame:
    """Vectors (doc_id, embedding) with their norm, to compute once."""
    return vectors.withColumn("norm", E.norm(F.col("embedding")))


def nearest(vectors: DataFrame, queries: DataFrame, top_k: int = TOP_K[2], directory: bool = False, stretch: float = 1.0) -> DataFrame:
    """query_id, doc_id, score and rank of the top_k vectors of each query by cosine; ties go to the smaller doc_id.

    vectors: doc_id, embedding, norm and, with directory, hierarchy_path; queries: query_id, embedding and
    directory (null: all), a prefix that is applied before the top-k. A query's own top_k, where the
    column is there, holds. Vectors are read once for each block of queries of bounded size; each task keeps top_k
    of a query (``best.Near``), and these alone are shuffled.
    """
    within("top_k", top_k, TOP_K)
    spark, own = vectors.sparkSession, "top_k" in queries.columns
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q_e"), E.norm(F.col("embedding")).alias("q_n"), (F.col("directory") if directory else F.lit(None).cast("string")).alias("q_dir"), *([F.least(F.col("top_k"), F.lit(TOP_K[1])).alias("q_k")] if own else []))
    q = written(q.withColumn("query", F.monotonically_increasing_id()))
    size = q.agg(F.max(F.size("q_e"))).first()[0] or 1
    rows = vectors.select("doc_id", "embedding", "norm", *(["hierarchy_path"] if directory else [])).repartition(spark.sparkContext.defaultParallelism)
    rows = rows.withColumns({"embedding": F.col("embedding").cast("array<double>"), "norm": F.col("norm").cast("double")})
    ship(spark)
    out = None
    for block in query_blocks(q, max(1, NUMBERS // max(size, 1)), "query"):
        some = block.collect()  # at most some NUMBERS numbers
        part = rows.mapInArrow(best.near([r["query"] for r in some], [(r["q_e"], r["q_n"], r["q_dir"]) for r in some], TOP_K[1] if own else top_k, stretch), T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))
        out = part if out is None else out.union(part)
    hits = out.join(few(q.select("query", "query_id", *(["q_k"] if own else []))), "query").drop("query")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = hits.select("query_id", "doc_id", "score", *(["q_k"] if own else [])).withColumn("rank", F.row_number().over(first))
    return ranked.filter(F.col("rank") <= (F.least(F.col("q_k"), F.lit(TOP_K[1])) if own else F.lit(top_k))).drop("q_k")


def retrieve_l0(hits: DataFrame, documents: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Hits joined with their documents; hits below min_score or without a document go. Ranks stay in order with gaps closed."""
    rows = hits.filter(F.col("score") >= min_score).join(documents, "doc_id")
    return rows.withColumn("rank", F.row_number().over(_windows()[1]))


def expand_l1(rows: DataFrame, threshold: float = L1_SCORE, indices: list[int] | None = None) -> DataFrame:
    """tier and tokens of rows once overviews are loaded for those of this score that have one (all, or these indices from 0)."""
    chosen = F.col("rank").isin([i + 1 for i in indices]) if indices is not None else F.lit(True)
    ready = chosen & (F.col("score") >= threshold) & (F.coalesce(F.length("l1_overview"), F.lit(0)) > 0)
    return rows.withColumn("tier", F.when(ready, "l1").otherwise("l0")).withColumn("tokens_used", F.when(ready, F.col("l1_tokens")).otherwise(F.col("l0_tokens")))


def load_l2(rows: DataFrame, contents: DataFrame, indices: list[int]) -> DataFrame:
    """Rows with ``l2_content`` at these indices from 0 where the text exists; indices out of range do nothing. Needs tier and tokens_used."""
    text = contents.select("l2_file_path", F.col("content").alias("l2_content"))
    got = rows.join(text, "l2_file_path", "left").withColumn("_on", F.col("rank").isin([i + 1 for i in indices]) & F.col("l2_content").isNotNull())
    out = got.withColumn("tier", F.when(F.col("_on"), "l2").otherwise(F.col("tier"))).withColumn("tokens_used", F.when(F.col("_on"), F.col("l2_tokens")).otherwise(F.col("tokens_used")))
    return out.withColumn("l2_content", F.when(F.col("_on"), F.col("l2_content"))).drop("_on")


def escalate(rows: DataFrame, budget: Column) -> DataFrame:
    """tier and tokens_used of each row of ``retrieve_l0`` (with l2_exists) under the query's budget.

    The first L1_SLOTS rows of score L1_SCORE get their overview if it isn't empty and the abstracts and
    a flat charge fit; the first row of score L2_SCORE whose full text fits on top gets it, if it exists.
    Tokens replace each other; the budget isn't a cap on what is returned.
    """
    q, ranked = _windows()
    has_l1 = F.coalesce(F.length("l1_overview"), F.lit(0)) > 0
    eligible = F.sum((F.col("score") >= L1_SCORE).cast("int")).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_budget": budget, "_u0": F.sum("l0_tokens").over(q), "_c": eligible})
    rows = rows.withColumn("_e1", (F.col("score") >= L1_SCORE) & (F.col("_c") <= L1_SLOTS) & (F.col("_u0") + L1_CHARGE <= F.col("_budget")) & has_l1)
    rows = rows.withColumn("_u1", F.sum(F.when(F.col("_e1"), F.col("l1_tokens")).otherwise(F.col("l0_tokens"))).over(q))
    fits = (F.col("score") >= L2_SCORE) & (F.col("_u1") + F.col("l2_tokens") <= F.col("_budget"))
    rows = rows.withColumn("_k2", F.min(F.when(fits, F.col("rank"))).over(q))
    tier = F.when((F.col("rank") == F.col("_k2")) & F.col("l2_exists"), "l2").when(F.col("_e1"), "l1").otherwise("l0")
    rows = rows.withColumn("tier", tier)
    used = F.when(F.col("tier") == "l2", F.col("l2_tokens")).when(F.col("tier") == "l1", F.col("l1_tokens")).otherwise(F.col("l0_tokens"))
    return rows.withColumn("tokens_used", used.cast("long")).withColumn("l1_loaded", F.col("_e1")).drop("_budget", "_u0", "_c", "_e1", "_u1", "_k2")


def smart_query(vectors: DataFrame | None, documents: DataFrame, contents: DataFrame, queries: DataFrame, top_k: int = TOP_K[2], directory: bool = False, stretch: float = 1.0, hits: DataFrame | None = None) -> DataFrame:
    """A row for each result: query_id, rank, doc_id, title, hierarchy_path, score (4 places), tier, tokens_used, l0_abstract, l1_overview and l2_content where loaded.

    queries: query_id, embedding, token_budget and, with directory, directory. contents: l2_file_path, content.
    hits: what a search gave (query_id, doc_id, score, rank), such as an index's, in place of vectors.
    """
    # a bounded number of queries has a bounded number of hits: then these go to the tables, not the tables to them
    small = F.broadcast if queries.count() <= QUERY_BLOCK else (lambda df: df)
    hits = written(nearest(vectors, queries, top_k, directory, stretch) if hits is None else hits)  # the search is done once
    rows = written(retrieve_l0(small(hits), documents))
    known = contents.select("l2_file_path").join(small(rows.select("l2_file_path").distinct()), "l2_file_path", "left_semi").distinct().withColumn("l2_exists", F.lit(True))
    rows = rows.join(small(known), "l2_file_path", "left").withColumn("l2_exists", F.coalesce("l2_exists", F.lit(False)))
    budgets = queries.select("query_id", F.greatest(F.lit(BUDGET[0]), F.least(F.lit(BUDGET[1]), F.col("token_budget"))).alias("token_budget"))
    rows = escalate(rows.join(small(budgets), "query_id"), F.col("token_budget"))
    loaded = contents.select("l2_file_path", F.col("content").alias("l2_content")).join(small(rows.filter("tier = 'l2'")), "l2_file_path")
    out = rows.filter("tier <> 'l2'").withColumn("l2_content", F.lit(None).cast("string")).unionByName(loaded.select(*rows.columns, "l2_content"))
    return out.select("query_id", "rank", "doc_id", "title", "hierarchy_path", E.half_up(F.col("score")).alias("score"), "tier", "tokens_used", "l0_abstract", F.when(F.col("l1_loaded"), F.col("l1_overview")).alias("l1_overview"), "l2_content")


def summaries(results: DataFrame) -> DataFrame:
    """Each query's header: l0_count (results), l1_count (overviews), l2_count and total_tokens."""
    return results.groupBy("query_id").agg(
        F.count("*").alias("l0_count"), F.count("l1_overview").alias("l1_count"), F.count_if(F.col("tier") == "l2").alias("l2_count"), F.sum("tokens_used").alias("total_tokens")
    )


def document_tier(documents: DataFrame, contents: DataFrame, asked: Column) -> DataFrame:
    """doc_id, tier, content, tokens and fallback of each document at the tier asked for (l0, l1 or l2); other tiers give no row.

    Without an overview l1 gives the abstract; without its full text l2 gives the overview or abstract as l1, with fallback.
    """
    text = contents.select("l2_file_path", F.col("content").alias("_l2"))
    d = documents.withColumn("_asked", asked).join(text, "l2_file_path", "left").filter(F.col("_asked").isin("l0", "l1", "l2"))
    has_l1 = F.coalesce(F.length("l1_overview"), F.lit(0)) > 0
    second, second_tokens = F.when(has_l1, F.col("l1_overview")).otherwise(F.col("l0_abstract")), F.when(has_l1, F.col("l1_tokens")).otherwise(F.col("l0_tokens"))
    lost = (F.col("_asked") == "l2") & F.col("_l2").isNull()
    return d.select(
        "doc_id",
        F.when(lost, "l1").otherwise(F.col("_asked")).alias("tier"),
        F.when(F.col("_asked") == "l0", F.col("l0_abstract")).when((F.col("_asked") == "l1") | lost, second).otherwise(F.col("_l2")).alias("content"),
        F.when(F.col("_asked") == "l0", F.col("l0_tokens")).when((F.col("_asked") == "l1") | lost, second_tokens).otherwise(F.col("l2_tokens")).cast("long").alias("tokens"),
        lost.alias("fallback"),
    )


def query_log(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows to append to the query log: for each query the retrieval, and a second row with the agent for one that has results."""
    s = summaries(results)
    l0 = results.join(s.select("query_id"), "query_id").groupBy("query_id").agg(F.sum(F.floor(F.length("l0_abstract") / 4)).alias("l0_sum"))
    every = queries.select("query_id", "query_text", "agent_id").join(s, "query_id", "left").join(l0, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    first = every.select("query_id", F.lit(1).alias("step"), "query_text", F.lit(None).cast("string").alias("agent_id"), zero("l0_count").alias("l0_results"), F.lit(0).cast("long").alias("l1_expansions"), F.lit(0).cast("long").alias("l2_loads"), zero("l0_sum").alias("total_tokens"))
    second = every.filter("l0_count IS NOT NULL").select("query_id", F.lit(2).alias("step"), "query_text", "agent_id", zero("l0_count"), zero("l1_count"), zero("l2_count"), zero("total_tokens"))
    return first.union(second)


def list_documents(documents: DataFrame) -> DataFrame:
    """All documents, last written first: the listing's columns and order. updated_at is the time of insertion."""
    return documents.orderBy(F.desc("updated_at"), F.desc("seq")).select("doc_id", "title", "hierarchy_path", "doc_type", F.col("l0_token_count").alias("l0_tokens"), F.col("l1_token_count").alias("l1_tokens"), F.col("l2_token_count").alias("l2_tokens"), "is_stale")


def by_hierarchy(documents: DataFrame, prefix: str) -> DataFrame:
    """Documents whose path matches ``prefix%`` without regard to case (% and _ in it are wild), by path."""
    return documents.filter(F.lower("hierarchy_path").like(prefix.lower() + "%")).orderBy("hierarchy_path", "doc_id")
