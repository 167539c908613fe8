"""An index of a log's entries by the trigrams of their lower-cased lines.

Entries lie in pages of consecutive rows; for each trigram there are the pages that have it, as gaps
in ascending order. A term of three characters or more can only stand in pages that have all its
trigrams; the rarest few choose the pages, whose entries then take the exact test. Shorter terms are
looked for in all entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..model import LIMIT, within
from ..session import few, ship, written
from . import memory

#: The logarithms of an entry's page size and of the pages that share a row of postings, and the trigrams of a term that are looked up.
PAGE, GROUP, GRAMS = 6, 12, 4
#: Terms of a literal query whose pages are at most so many are read by page; trigrams in a larger share of pages choose nothing.
PAGES, SHARE = 1000, 0.5
#: Trigrams of pages that a task holds at once.
PAIRS = 4_000_000
#: What ends a line among others: half of a surrogate pair, which no text has alone.
_END, _STOP, _LOW = "\ud800", 0xD800, (1 << 21) - 1


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, bucket and pages (within it, ascending) of lines and their pages, which lie in order; a row for each gram of a group of pages, or of PAIRS grams of pages."""
    codes, pages, size, bucket = [], [], 0, None

    def put() -> Iterator[pa.RecordBatch]:
        c, p = np.concatenate(codes), np.concatenate(pages)
        by = np.lexsort((p, c))
        c, p = c[by], p[by]
        new = np.append(True, (c[1:] != c[:-1]) | (p[1:] != p[:-1]))
        c, p = c[new], p[new]
        cuts = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
        text = [chr(x & _LOW) + chr(x >> 21 & _LOW) + chr(x >> 42) for x in c[cuts[:-1]].tolist()]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(p, pa.int32()))
        for i in range(0, len(text), 10_000):
            part = text[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([bucket] * len(part), pa.int64()), lists.slice(i, len(part))], ["gram", "bucket", "pages"])

    for b in batches:
        lines, page = [x or "" for x in b.column(0).to_pylist()], b.column(1).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(page[1:] != page[:-1]) + 1).tolist() if len(page) else []
        for at, to in zip(starts, [*starts[1:], len(page)], strict=True):
            if bucket is not None and size and (int(page[at]) >> GROUP != bucket or size > PAIRS):
                yield from put()
                codes, pages, size = [], [], 0
            bucket = int(page[at]) >> GROUP
            # a line's end is a code of its own, which no trigram has
            x = np.frombuffer((_END.join(lines[at:to])).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if len(x) < 3:
                continue
            inner = x != _STOP
            inner = inner[:-2] & inner[1:-1] & inner[2:]
            got = pd.unique((x[:-2] | x[1:-1] << 21 | x[2:] << 42)[inner])
            codes.append(got)
            pages.append(np.full(len(got), int(page[at]) & ((1 << GROUP) - 1), np.int32))
            size += len(got)
    if size:
        yield from put()


class TrigramIndex:
    """An index below a folder: ``rows`` (entries with ``at``, their number, and ``page``), ``postings`` (gram, bucket, n, gaps) and ``grams`` (gram, n: in how many pages; of the empty one: all)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, entries: DataFrame) -> TrigramIndex:
        """Writes entries (as the functions of ``memory`` take them, with any other columns) and their postings. An empty frame makes an empty index."""
        numbered = entries.withColumn("at", F.monotonically_increasing_id())
        numbered.withColumn("page", F.shiftright("at", PAGE)).write.parquet(f"{self.root}/rows")
        ship(self.spark)
        found = written(self.rows().select("raw_lc", "page").mapInArrow(_postings, "gram string, bucket long, pages array<int>"))
        # of a trigram that every page has, each group of pages is a row; a page that two tasks read is in both of theirs
        found = found.repartitionByRange("gram", "bucket").groupBy("gram", "bucket").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
        found = found.select("gram", "bucket", F.inline(F.array(F.struct("pages", F.concat(F.array(F.lit(0)), F.col("pages")).alias("before")))))
        gaps = F.slice(F.zip_with("pages", "before", lambda a, b: a - b), 1, F.size("pages"))
        found.select("gram", "bucket", F.size("pages").alias("n"), gaps.alias("gaps")).sortWithinPartitions("gram", "bucket").write.parquet(f"{self.root}/postings")
        every = self.rows().select(F.lit("").alias("gram"), F.count_distinct("page").alias("n"))
        self.postings().groupBy("gram").agg(F.sum("n").alias("n")).unionByName(every).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.root}/grams")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/grams")

    @staticmethod
    def _pages(postings: DataFrame, *keep: str) -> DataFrame:
        """gram (and ``keep``) and page for each page of these postings: running sums of the gaps."""
        zero = F.array().cast("array<int>")
        pages = F.aggregate("gaps", zero, lambda acc, g: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + g)))
        return postings.select("gram", *keep, F.explode(F.transform(pages, lambda p: F.shiftleft(F.col("bucket"), GROUP) + p)).alias("page"))

    def pages(self, terms: list[str]) -> DataFrame | None:
        """The pages that can hold one of these terms; none if a term is too short, or its trigrams too common, to tell."""
        terms = list(dict.fromkeys(terms))
        if any(len(t) < 3 for t in terms):
            return None
        of = {t: sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in terms}
        every = sorted({g for x in of.values() for g in x})
        n = {r["gram"]: r["n"] for r in self.counts().filter(F.col("gram").isin("", *every)).collect()}  # a row for each trigram of the query
        chosen = {t: sorted(x, key=lambda g: (n[g], g))[:GRAMS] for t, x in of.items() if all(g in n for g in x)}
        if not chosen:
            return self.spark.createDataFrame([], "page long")
        if any(n[x[0]] > SHARE * n[""] for x in chosen.values()):
            return None
        wanted = F.broadcast(self.spark.createDataFrame([(t, g, len(x)) for t, x in chosen.items() for g in x], "term string, gram string, need int"))
        found = self._pages(self.postings().filter(F.col("gram").isin(sorted({g for x in chosen.values() for g in x})))).join(wanted, "gram")
        return found.groupBy("term", "page").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need").select("page").distinct()

    def candidates(self, query: str) -> DataFrame:
        """The entries of pages that can hold a term of a literal query, or all entries."""
        found = self.pages(E.terms_of(query))
        if found is None:
            return self.rows()
        found = written(found)
        if found.count() <= PAGES:
            # so few that the file format leaves out the others
            return self.rows().filter(F.col("page").isin([r["page"] for r in found.collect()]))
        return self.rows().join(few(found), "page", "left_semi")

    def search(self, query: str, now: Column, **options: object) -> DataFrame:
        """``memory.search`` over the entries, by the index."""
        return memory.search(self.candidates(query), query, now, **options)

    def search_batch(self, queries: DataFrame, now: Column, limit: int = LIMIT[2], tiers: list[str] | None = None) -> DataFrame:
        """``memory.search_batch`` over the entries, by the index: the entries of the pages that can hold a term of any query are scanned once for all.

        Queries with a term of under three characters, or one whose trigrams are in more than SHARE of all pages, are
        answered by a scan of all entries.
        """
        within("limit", limit, LIMIT)
        asked = written(queries.select("query_id", "query", E.terms_column(F.col("query")).alias("terms")).filter("size(terms) > 0"))
        words = asked.select(F.explode("terms").alias("term")).distinct().filter(F.length("term") >= 3)
        rare = Window.partitionBy("term").orderBy("n", "gram")
        known = words.select("term", F.explode(grams(F.col("term"))).alias("gram")).join(self.counts(), "gram", "left")
        known = written(known.withColumns({"place": F.row_number().over(rare), "none": F.max(F.col("n").isNull()).over(Window.partitionBy("term"))}))
        every = self.counts().filter("gram = ''").first()["n"]
        common = known.filter(~F.col("none") & (F.col("place") == 1) & (F.col("n") > SHARE * every)).select("term")
        long = asked.select("query_id", F.explode("terms").alias("term")).join(few(common), "term", "left_semi").select("query_id")
        long = long.unionByName(asked.filter(F.exists("terms", lambda t: F.length(t) < 3)).select("query_id")).distinct()
        scanned = few(long)
        paged, rest = (written(asked.join(scanned, "query_id", how)) for how in ("left_anti", "left_semi"))
        wanted = known.filter(f"NOT none AND place <= {GRAMS}").join(few(paged.select(F.explode("terms").alias("term")).distinct()), "term", "left_semi").select("term", "gram")
        wanted = written(wanted.join(wanted.groupBy("term").agg(F.count("*").alias("need")), "term"))
        spots = self._pages(self.postings().join(few(wanted), "gram"), "term", "need")
        spots = spots.groupBy("term", "page", "need").agg(F.count("*").alias("n")).filter("n = need").select("page").distinct()
        parts = []
        if not paged.isEmpty():
            parts.append(memory.search_batch(self.rows().join(few(spots), "page", "left_semi"), paged.select("query_id", "query"), now, limit, tiers))
        if not rest.isEmpty() or not parts:
            parts.append(memory.search_batch(self.rows(), rest.select("query_id", "query"), now, limit, tiers))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
