"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are joined on shared seeds, the hashes of SEED consecutive words that a
running Karp-Rabin hash gives. For each joined pair the longest match of unmarked words is marked
again and again, down to SEED words; running hashes of any length find it in time and memory that
grow with the words, not with their pairs. Tiles may come in any order, so reordered passages count.
An item is in a document when its tiles cover COVERAGE of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import filter_of, passes
from .common import arrow, table, written
from .textnum import ALNUM, Running, Words, chunks, lists_of, sequence_hash

SEED, COVERAGE = 5, 0.5


def tiles(doc: np.ndarray, item: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in doc, start in item, length), longest first.

    If some length has a match, so has any shorter one, so the longest is found by halving. Ties go to
    the earlier place in the item, then in the document. An item shorter than seed is matched whole.
    """
    seed = min(seed, len(item))
    if not seed or len(doc) < seed:
        return []
    a, b = Running(doc), Running(item)
    hits = np.arange(len(doc) - seed + 1)
    hits = hits[np.isin(a.at(hits, seed), b.at(np.arange(len(item) - seed + 1), seed))]  # a match begins with a seed
    in_doc, in_item = np.zeros(len(doc) + 1, np.int64), np.zeros(len(item) + 1, np.int64)  # marked words before each place

    def match(n: int) -> tuple[int, int] | None:
        """Places in document and item of the first match of n unmarked words."""
        to = np.flatnonzero(in_item[n:] == in_item[: len(item) - n + 1])
        at = hits[hits <= len(doc) - n]
        at = at[in_doc[at + n] == in_doc[at]]
        if not len(to) or not len(at):
            return None
        there, here = b.at(to, n), a.at(at, n)
        for j in np.flatnonzero(np.isin(there, here)).tolist():
            for i in at[here == there[j]].tolist():
                if np.array_equal(doc[i : i + n], item[to[j] : to[j] + n]):
                    return i, int(to[j])
        return None

    out, high = [], min(len(doc), len(item))
    while True:
        low, best = seed - 1, None  # low has a match, high may
        while low < high:
            n = (low + high + 1) // 2
            if (found := match(n)) is None:
                high = n - 1
            else:
                low, best = n, found
        if best is None:
            return out
        i, j = best
        out.append((i, j, low))
        for marks, at in ((in_doc, i), (in_item, j)):
            marks[at + 1 : at + low + 1] += np.arange(1, low + 1)
            marks[at + low + 1 :] += low
        high = low


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_item_words, n_covered, n_tiles and coverage of each pair whose tiles cover enough of the item.

    Items of equal words are one, under their smallest item_id; items without words and null texts match
    nothing. Items shorter than seed words are found whole. Repeated rows of docs give repeated rows, empty
    tables none. A very long text is looked through whole, in memory that grows with its words.
    """
    spark = docs.sparkSession

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, encoded in chunks(b.column(1).to_pylist()):
                w = Words(encoded, ALNUM)
                grams = w.grams(seed)
                hashes = [w.hash[w.bounds[i] : w.bounds[i + 1]] for i in range(len(encoded))]
                seeds = [grams[0][grams[1][i] : grams[1][i + 1]].view(np.int64) if len(h) >= seed else sequence_gram(h) for i, h in enumerate(hashes)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(encoded)), lists_of([h.view(np.int64) for h in hashes]), lists_of(seeds)], ["item_id", "words", "seeds"])

    items = arrow(benchmark.select(F.col("item_id").cast("long"), "text"), item_seeds, "item_id long, words array<long>, seeds array<long>").filter("size(words) > 0")
    items = written(items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("seeds").alias("seeds")))
    size = F.size("words")
    # tiles are of seed words at least, so that many of the item's places have a shared seed
    least = F.greatest(F.lit(1), F.ceil(size * coverage / seed - 1e-9))
    seeds = items.select("item_id", least.alias("least"), F.explode("seeds").alias("seed")).groupBy("item_id", "least", "seed").agg(F.count("*").alias("places"))
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(seed)).alias("n")).distinct().collect()]  # at most seed numbers
    held = spark.sparkContext.broadcast(filter_of(seeds.select("seed")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, encoded in chunks(b.column(1).to_pylist()):
                w = Words(encoded, ALNUM)
                rows, found, words = [], [], []
                hits = []
                for n in sizes:
                    grams, bounds = w.grams(n)
                    where = np.flatnonzero(passes(held.value, grams.view(np.int64)))
                    hits.append((np.searchsorted(bounds, where, "right") - 1, grams[where].view(np.int64)))
                doc, seen = (np.concatenate([h[k] for h in hits]) if hits else np.zeros(0, np.int64) for k in (0, 1))
                for i in np.unique(doc).tolist():
                    rows.append(at + i)
                    found.append(np.unique(seen[doc == i]))
                    words.append(w.hash[w.bounds[i] : w.bounds[i + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), lists_of(words), lists_of(found)], ["doc_id", "words", "seeds"])

    # the few documents that hold a seed go on, as word hashes
    near = written(arrow(docs.select(F.col("doc_id").cast("long"), "text"), probe, "doc_id long, words array<long>, seeds array<long>").select(F.expr("uuid()").alias("row"), "doc_id", "words", "seeds"))
    pairs = near.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("row", "item_id", "least").agg(F.sum("places").alias("places")).filter("places >= least")
    pairs = pairs.select("row", "item_id").join(items.select("item_id", "words"), "item_id")
    # a document and then its items, one by one: no task holds more than one document and one item
    stream = near.select("row", "doc_id", F.lit(None).cast("long").alias("item_id"), "words").union(pairs.select("row", F.lit(None).cast("long"), "item_id", "words"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, key, doc = None, None, np.zeros(0, np.int64)
        for b in batches:
            out = []
            lists = b.column(3)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, (r, d, i) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                words = flat[ends[k] : ends[k + 1]]
                if i is None:
                    row, key, doc = r, d, words.copy()
                elif r == row:
                    found = tiles(doc, words, seed)
                    covered = sum(t[2] for t in found)
                    if covered >= coverage * len(words) and found:
                        out.append((key, i, len(words), covered, len(found), covered / len(words)))
            kinds = (pa.int64(),) * 5 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["doc_id", "item_id", "n_item_words", "n_covered", "n_tiles", "coverage"])

    return arrow(stream.repartition("row").sortWithinPartitions("row", F.asc_nulls_first("item_id")), tile, "doc_id long, item_id long, n_item_words long, n_covered long, n_tiles long, coverage double")


def sequence_gram(words: np.ndarray) -> np.ndarray:
    """The hash that ``Words.grams`` gives to a whole short sequence."""
    return sequence_hash(words).view(np.int64) if len(words) else np.zeros(0, np.int64)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
