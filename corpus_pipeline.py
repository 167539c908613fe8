"""A training-data pipeline over documents: five stages, each one operator, written between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import few, table, written
from engramlake.llm.op3_toxicity import PREDICT, score_toxicity
from engramlake.llm.op7_ngrams import near_duplicates
from engramlake.llm.op8_lines import drop_lines
from engramlake.llm.op9_pieces import encode_texts
from engramlake.llm.op10_tiling import contaminated


def _rows(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select("row.*").select(*(F.col(f"`{c}`") for c in docs.columns))


def _hash(seed: int, *columns: F.Column) -> F.Column:
    return F.xxhash64(F.lit(seed), *columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """Every row as struct ``row``, with doc_id and ``key``, which is never null and tells rows of different doc_id or text apart.

    Keys have 64 bits, so among very many rows some unlike ones meet; a second hash finds these, and
    they get keys of it instead.
    """
    i = F.col("doc_id").cast("long")
    content = [i.isNull(), i, F.col("text").isNull(), F.col("text")]
    rows = docs.select(F.struct("*").alias("row"), i.alias("doc_id"), _hash(0, *content).alias("key"), _hash(1, *content).alias("other"))
    met = written(rows.groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").select("key", F.lit(True).alias("met")))
    if met.isEmpty():
        return rows.drop("other")
    apart = rows.join(few(met), "key", "left")
    return apart.select("row", "doc_id", F.when(F.col("met"), _hash(2, F.col("other"))).otherwise(F.col("key")).alias("key"))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't among keys: few keys go to the rows, so that texts stay where they are."""
    return rows.join(few(keys), "key", "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below PREDICT; null and empty texts have one too, and repeated rows the same."""
    return _rows(score_toxicity(docs, table(spark, sf_dir, "labels")).filter(F.col("score") < PREDICT), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that many of them share; n_chars follows the text, and a null text stays null if nothing was dropped."""
    out = drop_lines(docs)
    same = F.col("n_dropped") == 0
    text = F.when(same, F.col("row.text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (word 5-grams, Jaccard 0.8), the row with the smallest doc_id; documents without words stay.

    Rows are told apart by doc_id and text: rows without doc_id come last, and of equal rows one stays.
    """
    rows = _keyed(docs)
    near = near_duplicates(rows.select(F.col("key").alias("doc_id"), "row.text"), n=5, num=80, den=100).filter("n_shingles > 0")
    near = near.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"), F.count("*").alias("n"))
    near = written(near.join(rows.select("key", "doc_id").distinct(), "key"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = near.groupBy("component").agg(F.min(order).alias("first")).select("first.key")
    repeated = near.filter("n > 1").join(first, "key", "left_semi").select("key")
    gone = near.join(first, "key", "left_anti").select("key").union(repeated)
    kept = _without(rows, gone).select("row")
    if repeated.isEmpty():
        return _rows(kept, docs)
    return _rows(kept.union(rows.join(repeated, "key", "left_semi").dropDuplicates(["key"]).select("row")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by row: a doc_id may be null or have other texts."""
    rows = _keyed(docs)
    hits = contaminated(rows.select(F.col("key").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return _rows(_without(rows, hits), docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of each document; a null or empty text has none, and repeated rows repeat."""
    return encode_texts(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pieces", pieces)]
#: A trained network and piece segmentation aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
