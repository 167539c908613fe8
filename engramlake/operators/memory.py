"""The weighted memory log: filters, keyword ranking, counts, reinforcement, and the log on disk.

Functions take a frame of entries (``sources.jsonl.parse``): tier, file, line_no, raw, raw_lc, id, ts,
weight, e_tier, e_type. ``MemoryLog`` keeps them as Parquet, partitioned by tier and file; weights
change by outcomes: the entries that they touch are written anew beside the log, and ``compact`` puts them in
place for good.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..model import BAD, BOOST, DECAY, GOOD, LIMIT, PENALTY, TIERS, WEIGHT_HIGH, WEIGHT_LOW, check_tiers, within
from ..session import few, ship, written
from ..sources import jsonl
from . import best
from .tables import Tables, stamp

if TYPE_CHECKING:
    from .trigrams import TrigramIndex

#: Query batches of at most so many rows are broadcast; larger ones go through in blocks of that size.
QUERY_BLOCK = 1000
#: Queries of different words that a scan answers.
KEYS = 8192
#: Times as they are stored, in UTC.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def filtered(entries: DataFrame, tiers: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, min_weight: float | None = None) -> DataFrame:
    """Entries of these tiers, of a time as text not before and not after the bounds, of a least weight.

    Times compare as text: an entry without one fails a lower bound and passes an upper one.
    """
    out = entries
    if tiers:
        out = out.filter(F.col("tier").isin(check_tiers(tiers)))
    if date_from:
        out = out.filter(F.col("ts") >= date_from)
    if date_to:
        out = out.filter(F.col("ts").isNull() | (F.col("ts") <= date_to))
    if min_weight is not None:
        out = out.filter(F.col("weight") >= min_weight)
    return out


def _order(entries: DataFrame, tiers: list[str] | None = None) -> list[Column]:
    """Among equal scores: tiers as asked for, files as listed, lines as written (by append, if entries are of several)."""
    return [F.desc("unrounded"), *(c.asc() for c in _places(entries, tiers))]


def _places(entries: DataFrame, tiers: list[str] | None = None) -> list[Column]:
    chosen = check_tiers(tiers)
    rank = F.lit(len(chosen))
    for i, t in enumerate(chosen):
        rank = F.when(F.col("tier") == t, i).otherwise(rank)
    return [rank, E.file_order(F.col("file")), *(F.col(c) for c in ("append", "line_no") if c in entries.columns)]


def scored(entries: DataFrame, query: str, now: Column) -> DataFrame:
    """Entries that hold a term, with ``unrounded``: share of terms x weight x recency."""
    terms = E.terms_of(query)
    if not terms:
        return entries.filter(F.lit(False)).withColumn("unrounded", F.lit(0.0))
    n = E.hits(F.col("raw_lc"), terms)
    any_term = F.lit(False)
    for t in dict.fromkeys(terms):
        any_term = any_term | F.contains("raw_lc", F.lit(t))
    return entries.filter(any_term).withColumn("unrounded", n / float(len(terms)) * F.col("weight") * E.recency(F.col("ts"), now))


def _shown(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select(*more, F.col("e_tier").alias("tier"), F.col("e_type").alias("type"), F.col("raw").alias("entry"), E.half_up(F.col("unrounded")).alias("score"), "line_no")


def search(entries: DataFrame, query: str, now: Column, tiers: list[str] | None = None, limit: int = LIMIT[2], date_from: str | None = None, date_to: str | None = None, min_weight: float | None = None) -> DataFrame:
    """The best entries for a query: tier, type, entry, score (4 places) and line_no, in order.

    A top-n of each partition merged on the driver; nothing is shuffled.
    """
    within("limit", limit, LIMIT)
    hits = scored(filtered(entries, tiers, date_from, date_to, min_weight), query, now)
    return _shown(hits.orderBy(*_order(entries, tiers)).limit(limit))


def search_batch(entries: DataFrame, queries: DataFrame, now: Column, limit: int = LIMIT[2], tiers: list[str] | None = None) -> DataFrame:
    """The best entries for each of many queries (query_id, query): adds query_id and rank to the columns of ``search``.

    Queries of the same words are one. Entries are scanned once for each KEYS of these: each task keeps only the first
    ``limit`` of a query (``best.Words``), and these alone are shuffled.
    """
    within("limit", limit, LIMIT)
    spark, found = entries.sparkSession, filtered(entries, tiers)
    asked = written(queries.select("query_id", F.array_sort(E.terms_column(F.col("query"))).alias("terms")).filter("size(terms) > 0"))
    keys = written(asked.select("terms").distinct().withColumn("key", F.monotonically_increasing_id()))
    order = [c.alias(f"_o{i}") for i, c in enumerate(_places(found, tiers))]
    rows = found.select("raw_lc", F.col("weight").cast("double").alias("weight"), E.recency(F.col("ts"), now).alias("recency"), *order, "e_tier", "e_type", "raw", "line_no")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("unrounded", T.DoubleType()), *(T.StructField(f.name, f.dataType) for f in rows.schema.fields[3:])])
    ship(spark)
    out = None
    for block in query_blocks(keys, KEYS, "key"):
        some = block.collect()  # at most some KEYS lists of words
        part = rows.mapInArrow(best.words([r["key"] for r in some], [list(r["terms"]) for r in some], limit, len(order)), schema)
        out = part if out is None else out.union(part)
    w = Window.partitionBy("key").orderBy(F.desc("unrounded"), *(F.col(f"_o{i}").asc() for i in range(len(order))))
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return _shown(ranked.join(few(asked.join(keys, "terms").select("query_id", "key")), "key"), "query_id", "rank")


def query_blocks(rows: DataFrame, size: int = QUERY_BLOCK, key: str = "query_id") -> list[DataFrame]:
    """The query table in parts of about size rows, by hash of a key; one part if it is small."""
    n = -(-rows.count() // size)
    return [rows] if n <= 1 else [rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def counts(entries: DataFrame) -> DataFrame:
    """tier and entries, a row for each tier, 0 too."""
    every = entries.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return every.join(entries.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("entries"))


def in_order(events: DataFrame) -> DataFrame:
    """tier, id, scores (by seq) and at (the last one's time) of outcomes (tier, id, task_score, seq and, if there, ``at``). Those of one id go to one array, of a number and a time each, which ``compact`` empties."""
    step = F.struct("seq", F.col("task_score").cast("double").alias("task_score"), (F.col("at") if "at" in events.columns else F.lit(None).cast("string")).alias("at"))
    by_id = events.groupBy("tier", "id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return by_id.select("tier", "id", F.transform("steps", lambda x: x["task_score"]).alias("scores"), F.element_at("steps", -1)["at"].alias("at"))


def changes(entries: DataFrame, ordered: DataFrame, exact: bool = False) -> DataFrame:
    """The entries that outcomes in order (``in_order``) change, with ``weight`` after them and ``_at``, the last one's time.

    An outcome is for the entries of that id in the first file of the tier that has it; all rows there
    with the id change. Only ids and files of entries meet the outcomes.
    """
    by_id = ordered.select("tier", "id", F.col("scores").alias("_scores"), F.col("at").alias("_at"))
    first = entries.select("tier", "id", "file").join(by_id.select("tier", "id"), ["tier", "id"], "left_semi").groupBy("tier", "id").agg(F.min(E.file_order(F.col("file"))).alias("_first"))
    if exact:
        ship(entries.sparkSession)
    hit = entries.join(by_id.join(first, ["tier", "id"]), ["tier", "id"]).filter(E.file_order(F.col("file")) == F.col("_first"))
    fold = exact_fold(F.col("weight"), F.col("_scores")) if exact else E.reinforce_all(F.col("weight"), F.col("_scores"))
    return hit.select(*(fold.alias("weight") if c == "weight" else F.col(c) for c in entries.columns), "_at")


def reinforced(entries: DataFrame, events: DataFrame, exact: bool = False) -> DataFrame:
    """Entries with weights after events; see ``changes``. line_no tells the entries of a tier and file apart."""
    key = ["tier", "file", "line_no"]
    changed = changes(entries, in_order(events), exact).select(*key, F.col("weight").alias("_new"))
    return entries.join(changed, key, "left").withColumn("weight", F.coalesce("_new", "weight")).select(*entries.columns)


@F.pandas_udf(T.StringType())
def reweighted(raw: pd.Series, weight: pd.Series, at: pd.Series) -> pd.Series:
    """Stored lines with a new weight and when it came. Only lines that events touch come here; no built-in keeps an object's keys in order."""
    import json

    return pd.Series([json.dumps(json.loads(r) | {"weight": w} | ({} if t is None else {"_weight_updated_at": t}), ensure_ascii=False) for r, w, t in zip(raw, weight, at, strict=True)], dtype=object)


def exact_fold(weight: Column, scores: Column) -> Column:
    """``reinforce_all`` with Python's rounding, in Arrow batches."""
    @F.pandas_udf(T.DoubleType())
    def fold(w: pd.Series, s: pd.Series) -> pd.Series:
        def one(x: float, steps: object) -> float:
            for v in [] if steps is None else steps:
                x = round(max(WEIGHT_LOW, min(WEIGHT_HIGH, x * (BOOST if v > GOOD else PENALTY if v < BAD else DECAY))), 4)
            return x

        return pd.Series([one(a, b) for a, b in zip(w, s, strict=True)])

    return fold(weight, scores)


@F.pandas_udf(T.StringType())
def line_of(payload: pd.Series, id: pd.Series, ts: pd.Series, tags: pd.Series, weight: pd.Series, tier: pd.Series, kind: pd.Series, written: pd.Series) -> pd.Series:
    """The stored line of an entry: a payload's keys between those set here, in the separators that keyword matching relies on."""
    import json

    def one(p: str, i: str, t: str, g: object, w: float, e: str, k: str, at: str) -> str:
        return json.dumps({"id": i, "ts": t} | json.loads(p) | {"id": i, "ts": t, "tags": list(g), "weight": w, "_tier": e, "_type": k, "_written_at": at}, ensure_ascii=False)

    return pd.Series([one(*r) for r in zip(payload, id, ts, tags, weight, tier, kind, written, strict=True)], dtype=object)


def new_entries(payloads: DataFrame, now: Column) -> DataFrame:
    """Entries to append, from tier, type, payload (a JSON object as text), tags (array or null) and weight (or null).

    A payload's id and ts hold; its weight, tags (if tags are given and not empty) and marks don't. Unknown
    tiers are an error. Without an id, one is made from the content and its place, so that a retried task writes the same.
    """
    ship(payloads.sparkSession)
    v = F.try_parse_json("payload")
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    stamp = F.date_format(now, STAMP)
    made = F.sha2(F.concat_ws("|", "tier", "type", "payload", F.monotonically_increasing_id().cast("string"), stamp), 256)
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.coalesce(get("tags", "array<string>"), F.array().cast("array<string>")))
    rows = payloads.select(
        F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise(F.raise_error(F.concat(F.lit("unknown tier: "), F.col("tier")))).alias("tier"),
        E.route(F.col("tier"), F.col("type")).alias("file"),
        F.col("type").alias("e_type"),
        "payload",
        tags.alias("tags"),
        E.initial_weight(F.col("weight"), F.col("type")).alias("weight"),
        F.coalesce(get("id", "string"), made).alias("id"),
        F.coalesce(get("ts", "string"), stamp).alias("ts"),
        stamp.alias("_written_at"),
    )
    raw = line_of("payload", "id", "ts", "tags", "weight", "tier", "e_type", "_written_at")
    return rows.withColumn("raw", raw).select("tier", "file", "raw", F.lower("raw").alias("raw_lc"), "id", "ts", "weight", F.col("tier").alias("e_tier"), "e_type", F.array_contains(F.json_object_keys("payload"), "schema").alias("hidden"))


#: Entries that a log's searches broadcast to take out those that events changed.
CHANGED = 1_000_000


class MemoryLog:
    """A log below a folder: ``entries`` (Parquet by append, tier and file), ``events`` (outcomes), ``changed`` (entries that outcomes have changed, as they are now) and ``index`` (trigrams, if there)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = Tables(spark, root)

    ENTRIES = "raw string, raw_lc string, id string, ts string, weight double, e_tier string, e_type string, hidden boolean, line_no long, tier string, file string"
    EVENTS = "tier string, id string, task_score double, seq long, at string"
    #: An entry's own append is ``of``; the append of a changed one is its version.
    CHANGES = f"{ENTRIES}, of string"

    def append(self, payloads: DataFrame, now: Column, name: str | None = None) -> DataFrame:
        """Appends and returns id, tier and file of what was written; see ``new_entries`` and ``write``."""
        return self.write(new_entries(payloads, now), name)

    def write(self, entries: DataFrame, name: str | None = None) -> DataFrame:
        """Appends entries, in order after those of appends that began before, by any number of writers at once; nothing that is there is read.

        A line is told apart by its append and its line_no in it. An append of a given name replaces what it wrote before.
        """
        rows = entries if "hidden" in entries.columns else entries.withColumn("hidden", F.lit(False))
        rows = rows.withColumn("line_no", F.monotonically_increasing_id())
        name = self.tables.put(rows.select(*[c.split()[0] for c in self.ENTRIES.split(", ")]), "entries", "tier", "file", append=name)
        return self.tables.read("entries", self.ENTRIES, [name]).select("id", "tier", "file")

    def import_files(self, folder: str) -> DataFrame:
        """Appends the entries of a folder of JSON-lines files, with their line numbers as order."""
        return self.write(jsonl.parse(jsonl.read_files(self.spark, folder)).orderBy("tier", "file", "line_no"))

    def _rows(self, query: str | None = None) -> DataFrame:
        """Visible entries as they were written; with a query those alone that may hold a term, if there is an index: of appends since then all."""
        found = self._indexed() if query is not None else None
        if found is None:
            return self.tables.read("entries", self.ENTRIES).filter("NOT hidden")
        index, covered = found
        fresh = sorted(set(self.tables.appends("entries")) - set(covered))
        since = self.tables.read("entries", self.ENTRIES, fresh).filter("NOT hidden")
        return index.candidates(query).select(*since.columns).unionByName(since)

    def entries(self, query: str | None = None) -> DataFrame:
        """All visible entries (with a query: all that may hold one of its terms) with their present weights, in the stored line too.

        Outcomes were folded in when they came: changed entries take the place of what they were, the others
        are scanned as they are, unless more than CHANGED have changed.
        """
        rows, changed = self._rows(query), self._changed()
        if changed is None:
            return rows
        keys = changed.select("append", "line_no")
        keys = F.broadcast(keys) if changed.count() <= CHANGED else keys
        return rows.join(keys, ["append", "line_no"], "left_anti").unionByName(changed)

    def _changed(self) -> DataFrame | None:
        """Changed entries as they are now, under their own appends; none if nothing has changed."""
        versions = self.tables.appends("changed")
        if not versions:
            return None
        rows = self.tables.read("changed", self.CHANGES, versions)
        if len(versions) > 1:
            last = rows.groupBy("of", "line_no").agg(F.max("append").alias("append"))
            rows = rows.join(few(last), ["of", "line_no", "append"], "left_semi")
        return rows.drop("append").withColumnRenamed("of", "append")

    def put_changed(self, ordered: DataFrame, exact: bool = False, version: str | None = None) -> DataFrame:
        """Writes the entries that outcomes (``in_order``: all of these ids, since the log began) change; returns them."""
        ship(self.spark)
        new = changes(self._rows(), ordered, exact).withColumn("raw", reweighted("raw", "weight", "_at")).withColumn("raw_lc", F.lower("raw"))
        version = self.tables.put(new.withColumnRenamed("append", "of").select(*[c.split()[0] for c in self.CHANGES.split(", ")]), "changed", append=version)
        return self.tables.read("changed", self.CHANGES, [version])

    def search(self, query: str, now: Column, **options: object) -> DataFrame:
        return search(self.entries(query), query, now, **options)

    def search_batch(self, queries: DataFrame, now: Column, **options: object) -> DataFrame:
        return search_batch(self.entries(), queries, now, **options)

    def counts(self) -> DataFrame:
        return counts(self._rows())

    def total(self) -> int:
        return self.counts().agg(F.sum("entries")).first()[0]

    def adjust(self, events: DataFrame, now: Column | None = None, exact: bool = False) -> DataFrame:
        """Records outcomes (tier, id, task_score in [0, 1], seq), writes the entries they change and returns these, with their new weights; of no row: no such id.

        All outcomes of the ids are taken in order of seq, so late ones take their place. Of calls at once on
        an id the one that read last has seen what the others recorded, and its version holds.
        """
        bad = events.filter(~F.col("task_score").between(0, 1) | ~F.col("tier").isin(*TIERS))
        if not bad.isEmpty():
            raise ValueError("task_score must lie between 0 and 1 and tiers must exist")
        known = self._rows().select("tier", "id").join(F.broadcast(few(events.select("tier", "id").distinct())), ["tier", "id"], "left_semi").distinct()
        found = written(events.join(few(known), ["tier", "id"], "left_semi").withColumn("at", F.date_format(F.current_timestamp() if now is None else now, STAMP)))
        self.tables.put(found.select("tier", "id", F.col("task_score").cast("double"), F.col("seq").cast("long"), "at"), "events")
        version = stamp()  # before the outcomes are read
        every = self.tables.read("events", self.EVENTS).join(few(found.select("tier", "id").distinct()), ["tier", "id"], "left_semi")
        return self.put_changed(in_order(every), exact, version).select("tier", "id", "file", "weight", F.col("raw").alias("entry"))

    def index(self) -> TrigramIndex:
        """Makes an index of the entries so far, which searches then use; entries that come later are scanned until the next one."""
        from .trigrams import TrigramIndex

        covered, name = self.tables.appends("entries"), stamp()
        made = TrigramIndex(self.spark, f"{self.root}/index/{name}").build(self.tables.read("entries", self.ENTRIES, covered).filter("NOT hidden"))
        self.tables.put(self.spark.createDataFrame([(a,) for a in covered], "covered string").coalesce(1), "indexed", append=name)
        return made

    def _indexed(self) -> tuple[TrigramIndex, list[str]] | None:
        """The last index that is done, and the appends it covers."""
        from .trigrams import TrigramIndex

        names = self.tables.appends("indexed")
        if not names:
            return None
        return TrigramIndex(self.spark, f"{self.root}/index/{names[-1]}"), [r["covered"] for r in self.tables.read("indexed", "covered string", names[-1:]).collect()]

    def compact(self, to: str) -> MemoryLog:
        """A new log elsewhere, in one append, with the outcomes folded into the weights for good."""
        done = MemoryLog(self.spark, to)
        rows = self.entries().orderBy("append", "line_no").withColumn("line_no", F.monotonically_increasing_id()).drop("append")
        done.tables.put(rows, "entries", "tier", "file")
        return done

    def health(self) -> DataFrame:
        """A row with the total and the counts by tier."""
        return self.counts().agg(F.sum("entries").alias("total"), F.map_from_entries(F.collect_list(F.struct("tier", "entries"))).alias("tiers"))
