"""Line dedup: lines whose key occurs in many documents go, in every document.

Keys are hashed to 128 bits and range-partitioned by (hash, salt of the document) with a secondary
sort by document and position. One pass over that order streams the first occurrence of every key
and the number of its documents; a key's salts meet as partial counts, so that a line found in a
third of all documents is spread over ``SALTS`` groups. What comes back per document is a
run-length compressed keep bitmap, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, once, table, text_hash, texts, written

SALTS = 64
MIN_DOCS, MIN_CHARS = 10, 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, pos and the key's two hashes, range-partitioned and sorted by key, salt, document and position.

    Adds ``new_doc`` (1 at the first line of a key in a document) and ``first`` (true at the first
    line of a key within its salt). Lines whose key has under min_chars code points are left out.
    """
    # hashed before: what a generator's row is made of is made for each line
    rows = texts(docs).select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    lines = rows.select("doc_id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    keys = keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(8), "key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    order = ["h1", "h2", "salt", "doc_id", "text_hash", "pos"]
    # written first: the ranges' bounds are sampled from hashes, so that texts are split once
    ranged = written(keys).repartitionByRange("h1", "h2", "salt").sortWithinPartitions(*order)
    w = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "text_hash", "pos")
    return ranged.select(*order, F.row_number().over(w).alias("n"), F.lag("doc_id").over(w).alias("last")).select(
        *order, (F.col("n") == 1).alias("first"), F.when((F.col("n") == 1) | ~F.col("doc_id").eqNullSafe(F.col("last")), 1).otherwise(0).alias("new_doc")
    )


def line_keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """One row per distinct (doc_id, text_hash) that loses lines: ``dropped``, the sorted positions from 0.

    With keep_first, a key's first line by document, text and position stays. Documents are told apart by doc_id (null counts as one id); repeated rows count once. Null and
    empty texts are one empty line, whose key is too short to be dropped.
    """
    seen = written(line_occurrences(docs, min_chars))  # hashes and places alone
    place = F.struct("doc_id", "text_hash", "pos")
    part = seen.groupBy("h1", "h2", "salt").agg(F.sum("new_doc").alias("n_docs"), F.min(F.when(F.col("first"), place)).alias("first_place"))
    frequent = part.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("first_place").alias("kept")).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "kept")
    # a frequent key meets its salts, at most SALTS rows, and only then the lines
    salted = part.select("h1", "h2", "salt").join(frequent, ["h1", "h2"])
    gone = seen.join(salted, ["h1", "h2", "salt"])
    if keep_first:
        gone = gone.filter(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def with_runs(rows: DataFrame) -> DataFrame:
    """rows (lines, dropped) with ``runs``, the keep bitmap as runs (start, length) of kept lines, and ``keeps``, a flag for each line; null where dropped is. Each array is made once, and none is searched, however many lines go."""
    ends = F.concat("dropped", F.array(F.size("lines")))
    out = once(rows, _ends=ends, _starts=F.concat(F.array(F.lit(-1)), "dropped"))
    runs = F.zip_with("_starts", "_ends", lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    flags = F.flatten(F.transform("_runs", lambda r: F.concat(F.array_repeat(F.lit(True), r["length"]), F.array(F.lit(False)))))
    out = once(out, _runs=runs)
    return once(out, runs=F.filter("_runs", lambda r: r["length"] > 0), keeps=flags).drop("_ends", "_starts", "_runs")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """Every row of docs as struct ``row``, with ``text`` (what stays, joined by a line feed), n_lines, n_dropped and keep_bitmap.

    keep_bitmap is a string of ``start+length`` runs of kept lines, comma-joined; empty if none stays. A null or
    empty text is one empty line, repeated rows repeat and count as one document, an empty table gives no
    rows. A very long text is split and joined once each, in time that grows with its lines, kept or dropped.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")
    gone = line_keep_bitmaps(docs, min_docs, min_chars, keep_first).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "dropped")
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    out = with_runs(once(out.select("row", "text", "dropped"), lines=_lines(F.col("text"))))
    stay = F.filter(F.zip_with("lines", "keeps", lambda line, keep: F.when(keep, line)), lambda line: line.isNotNull())
    kept = F.array_join(stay, "\n")
    return out.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.concat(F.lit("0+"), F.size("lines"))).otherwise(F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit("+"), r["length"])), ",")).alias("keep_bitmap"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), "keep_bitmap")


SQL = {
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)
), r AS (
  SELECT *, sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m
), b AS (
  SELECT doc_id, min(pos) AS p, min(pos) || '+' || count(*) AS run FROM r WHERE NOT gone GROUP BY doc_id, r.run
), s AS (
  SELECT doc_id, string_agg(run, ',' ORDER BY p) AS keep_bitmap FROM b GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM m GROUP BY doc_id
)
SELECT g.doc_id, n_lines, n_dropped, kept_sha256, coalesce(keep_bitmap, '') AS keep_bitmap FROM g LEFT JOIN s USING (doc_id)
"""
}
