"""N-gram Jaccard join: documents linked by the similarity of their sets of word 3-grams.

N-grams have one global order: rarest first, by counts over the whole corpus in a sketch of fixed
size, then by hash. Linked sets share an n-gram of their first ``n - ceil(t * n) + 1``, so these
prefixes are the keys under which sets meet; as prefixes hold a text's rarest n-grams, passages that
many documents share are no keys. Equal sets are one from the start; a prefix-tree join then finds
the links among sets that share keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import filters, passes
from .common import arrow, table, written
from .simjoin import BLOCK, cluster, packed, shared_keys, signatures
from .textnum import U, Words, chunks, long_lists, mix, sequence_hash

NGRAM, NUM, DEN = 3, 90, 100
#: Buckets of the count sketch, those of one of its rows, and how many classes of frequency it gives.
COUNTS, ROW, CLASSES = 1 << 24, 1 << 16, 64


class Grams:
    """The n-gram hashes of encoded texts with the text of each: all words as one where there are fewer than n, none without words."""

    def __init__(self, encoded: list[bytes], n: int) -> None:
        words = Words(encoded)
        grams, bounds = words.grams(n)
        size = np.diff(words.bounds)
        few = np.flatnonzero((size > 0) & (size < n))
        short = [sequence_hash(words.hash[words.bounds[i] : words.bounds[i + 1]]) for i in few.tolist()]
        self.hash = np.concatenate([grams, *short])
        self.text = np.concatenate([np.repeat(np.arange(len(encoded)), np.diff(bounds)), few])

    def sets(self, classes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct n-grams in the global order, as int64 that ascend in it, and the bounds of each text's."""
        rank = classes[(self.hash & U(COUNTS - 1)).astype(np.int64)].astype(U)
        token = ((rank << U(58) | self.hash >> U(6)) ^ U(1 << 63)).view(np.int64)
        order = np.lexsort((token, self.text))
        token, text = token[order], self.text[order]
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (text[1:] != text[:-1])])[: len(token)]
        return token[first], np.searchsorted(text[first], np.arange(texts + 1))


def frequency_classes(texts: DataFrame, n: int) -> np.ndarray:
    """The class of frequency of each bucket of n-gram hashes, from 0 (rarest), by counts over all texts (one column).

    A count that a bucket's other n-grams add only makes an n-gram look more frequent; any order gives
    the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTS, np.uint32)
        for b in batches:
            for _, encoded in chunks(b.column(0).to_pylist()):
                bucket, many = np.unique(Grams(encoded, n).hash & U(COUNTS - 1), return_counts=True)
                out[bucket.astype(np.int64)] += many.astype(np.uint32)
        yield from rows({i: x for i in range(COUNTS // ROW) if (x := out[i * ROW : (i + 1) * ROW]).any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(data, 4 * ROW, "zstd"), np.uint32)
                total = part + held.get(i, U(0).astype(np.uint32))
                held[i] = np.where(total < part, np.uint32(2**32 - 1), total)  # no count goes beyond
        yield from rows(held)

    def rows(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) for x in parts.values()], pa.binary())], ["row", "counts"])

    schema = "row long, counts binary"
    counts = np.zeros(COUNTS, np.uint32)
    for r in arrow(arrow(texts, count, schema).repartition("row"), add, schema).collect():  # COUNTS / ROW rows
        counts[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(pa.decompress(r["counts"], 4 * ROW, "zstd"), np.uint32)
    # half of the classes share the buckets evenly, the others the upper tail, each half of what is left
    half = CLASSES // 2
    at = np.concatenate([np.arange(1, half) / half, 1 - 0.5 ** np.arange(1, half) / half])
    at = np.unique(np.ceil(at * (COUNTS - 1)).astype(np.int64))
    bounds = np.unique(np.partition(counts, at)[at])
    return np.concatenate([np.searchsorted(bounds, counts[i : i + ROW], "right").astype(np.uint8) for i in range(0, COUNTS, ROW)])


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many first n-grams of sets of these sizes hold one of any linked set's: a linked set shares ceil(n * num / den) at least."""
    return np.where(n > 0, n + 1 + -n * num // den, 0)


def digests(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set; 0 for an empty one."""
    total = lambda seed: np.diff(np.concatenate([[U(0)], np.cumsum(mix(tokens.view(U) ^ U(seed)), dtype=U)])[bounds]).view(np.int64)
    return total(0xA5A5A5A5), total(0x3C6EF372FE94F82B)


def near_duplicates(docs: DataFrame, n: int = NGRAM, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included).

    Sets, not rows, are linked: equal sets are one node, told apart by 128 bits. Documents without
    words or text are linked with nothing. Rows that share a doc_id but not the text each have the
    component of their own set. A null doc_id is never a component's id: rows without one link others
    as any row does, and a component that only such rows have is null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row"))
    held = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs.select("text"), n))  # COUNTS bytes

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, encoded in chunks(b.column(1).to_pylist()):
                tokens, bounds = Grams(encoded, n).sets(held.value, len(encoded))
                size = np.diff(bounds)
                keys = prefix(size, num, den)
                ends = np.concatenate([[0], np.cumsum(keys)])
                which = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], keys)
                names = [pa.array(d) for d in digests(tokens, bounds)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(encoded)) for c in (0, 2)), pa.array(size), *names, pa.array(signatures(tokens, bounds)), long_lists(tokens[which], ends)], ["doc_id", "row", "n", "d1", "d2", "sig", "keys"])

    sketches = written(arrow(docs, sketch, "doc_id long, row long, n long, d1 long, d2 long, sig binary, keys array<long>"))
    equal = sketches.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    equal = written(equal.withColumn("node", F.monotonically_increasing_id()))  # a number from here on

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = written(equal.select("node", "d1", "d2", "row").join(nodes, "node", "left_semi"))
        out = None
        for part, among in filters(docs, wanted.select("row"), "row"):

            def run(batches: Iterator[pa.RecordBatch], among=among) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                sent: set[int] = set()  # rows that this task has returned, anew when they are many
                for b in batches:
                    rows = b.column(2).to_numpy(zero_copy_only=False)
                    some = [i for i in np.flatnonzero(passes(among.value, rows)).tolist() if rows[i] not in sent and not sent.add(rows[i])]
                    if len(sent) > 200_000:
                        sent.clear()
                    for _, encoded in chunks(b.column(1).take(pa.array(some, pa.int64())).to_pylist()):
                        tokens, bounds = Grams(encoded, n).sets(held.value, len(encoded))
                        yield pa.RecordBatch.from_arrays([*(pa.array(d) for d in digests(tokens, bounds)), long_lists(tokens, bounds)], ["d1", "d2", "tokens"])

            found = arrow(part, run, "d1 long, d2 long, tokens array<long>")
            out = found if out is None else out.union(found)
        sets = written(out.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).select(F.col("node").alias("name"), "node", "tokens"))
        once = sets.groupBy("node").count().filter("count > 1").isEmpty()
        return sets if once else sets.dropDuplicates(["node"])  # rows that are alike in doc_id and text

    found = cluster(written(shared_keys(packed(equal))), sets_of, num, den, block, equal.select("node", "n", "sig"))
    sets = equal.select("node", "d1", "d2", "doc_id").join(found, "node", "left").select("d1", "d2", "doc_id", F.coalesce("label", "node").alias("label"))
    least = sets.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = sets.join(least, "label").select("d1", "d2", "component_id")
    rows = sketches.select("doc_id", F.col("n").alias("n_shingles"), *(F.when(F.col("n") > 0, F.col(d)).alias(d) for d in ("d1", "d2")))
    return rows.join(component, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
