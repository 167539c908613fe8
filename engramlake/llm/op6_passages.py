"""Substring dedup: repeated passages, found as runs of repeated paragraphs and of repeated stretches of words.

Paragraphs here are the smallest pieces that a passage keeps wherever it is pasted: sentences, cut
at line feeds and at words that end with one of ``. ! ?``, joined where neighbours are short, and cut
again by content where they are long. Each has MinHash bands; paragraphs that collide in a band are
verified by the exact Jaccard similarity of their word 5-grams in a prefix-tree join, and components
of these links are clusters. Of each cluster the first paragraph stays.

A text that several documents have is one passage in each, and is looked into once. A passage needn't begin or end where a paragraph does, so stretches of STRETCH words are picked by
content as well, one at least in any STRETCH places in a row: every repeat of 2 * STRETCH - 1 words
holds one. One that several documents have grows word by word to both sides as far as it is the same
in another document. Repeated paragraphs and stretches that touch make a passage, reported from
MIN_WORDS words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bits import filter_of, passes
from .common import arrow, few, table, written
from .simjoin import BLOCK, PACKED, bucket_bits, cluster, pack, shared_keys
from .textnum import U, Words, chunks, lists_of, mix, running

SHINGLE, NUM, DEN = 5, 80, 100
#: Bands of ROWS hashes: a pair at 0.8 collides with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997, at 0.9 with 0.99999, at 0.2 with 0.06.
BANDS, ROWS = 8, 3
#: Neighbours under SHORT words are joined; paragraphs are cut at words of a certain hash from LONG words on.
SHORT, LONG, CUT = 8, 64, 16
#: Bytes of text that are worked on at a time, and clusters that are broadcast.
HELD, CLUSTERS = 1_000_000, 250_000
#: Words of a stretch and of a reported passage: a few under 51, so that one counts whose first or last words were changed.
STRETCH, MIN_WORDS = 26, 48
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U))
_STOPS = np.zeros(256, bool)
_STOPS[[33, 46, 63]] = True  # ! . ?
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[97:123] = _PLAIN[128:] = True


class Paragraphs:
    """The paragraphs of encoded texts: word ranges ``first:last``, ``doc``, 128-bit digests, and shingles with their bounds."""

    def __init__(self, encoded: list[bytes]) -> None:
        w = self.words = Words(encoded)
        n = len(w.start)
        doc = np.repeat(np.arange(len(encoded)), np.diff(w.bounds))
        lines = np.concatenate([[0], np.cumsum(w.data == 10)])
        last = np.ones(n, bool)
        if n > 1:
            ends = _STOPS[w.data[w.end - 1]] & (w.end - w.start > 1) & _PLAIN[w.data[np.maximum(w.end - 2, 0)]]
            last[:-1] = ends[:-1] | (lines[w.start[1:]] > lines[w.end[:-1]]) | (doc[1:] != doc[:-1])
        self.first, self.last = self._bounds(last)
        # neighbouring short sentences are one
        short = self.last - self.first < SHORT
        joint = np.flatnonzero(short[:-1] & short[1:] & (doc[self.last[:-1] - 1] == doc[self.first[1:]]))
        last[self.last[joint] - 1] = False
        self.first, self.last = self._bounds(last)
        # long ones part at words of a certain hash, so that equal stretches part alike
        long = np.flatnonzero(self.last - self.first >= LONG)
        if len(long):
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, self.first[long], 1)
            np.add.at(inside, self.last[long], -1)
            last |= (np.cumsum(inside)[:n] > 0) & (w.hash % U(CUT) == 0)
            self.first, self.last = self._bounds(last)
        self.doc = doc[self.first] if len(self.first) else np.zeros(0, np.int64)
        self.size = size = self.last - self.first
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        seats = np.cumsum(size) - size
        self.digest = [np.add.reduceat(mix(w.hash ^ mix(place.astype(U) + U(s))), seats).view(np.int64) if len(size) else np.zeros(0, np.int64) for s in (1, 1 << 40)]
        # the grams of a paragraph are those of its document that lie inside; all its words if they are fewer
        grams = running(w.hash, SHINGLE)
        count = np.maximum(size - SHINGLE + 1, 1)
        self.gram_bounds = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first - self.gram_bounds[:-1], count) + np.arange(count.sum())
        small = np.repeat(size < SHINGLE, count)
        self.grams = np.where(small, np.repeat(self.digest[0].view(U), count), grams[np.minimum(at, max(len(grams) - 1, 0))] if len(grams) else U(0))

    @staticmethod
    def _bounds(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(last) + 1
        return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends

    def band_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the bands and the paragraph of each; below SHORT words sets are linked only if equal and have none."""
        which = np.flatnonzero(self.size >= SHORT)
        if not len(which):
            return np.zeros(0, np.int64), which
        least = [np.minimum.reduceat(mix(self.grams ^ s), self.gram_bounds[:-1])[which] for s in _SEEDS]
        keys = [mix(sum((least[b * ROWS + r] * U(2 * r + 3) for r in range(1, ROWS)), least[b * ROWS]) + U(b)) for b in range(BANDS)]
        return np.concatenate(keys).view(np.int64), np.tile(which, BANDS)

    def sets(self, which: np.ndarray) -> list[np.ndarray]:
        g = self.grams.view(np.int64)
        return [np.unique(g[self.gram_bounds[i] : self.gram_bounds[i + 1]]) for i in which]


def stretches(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the picked stretches: those of the least hash among any STRETCH places in a row within a text."""
    k, grams = STRETCH, running(w.hash, STRETCH)
    if len(grams) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.arange(len(grams) - k + 1)
    least = start + np.lib.stride_tricks.sliding_window_view(grams, k).argmin(axis=1)
    at = np.unique(least[start + 2 * k - 1 <= w.bounds[np.searchsorted(w.bounds, start, "right")]])
    return at, grams[at].view(np.int64)


def code_points(w: Words) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])


def _who() -> Column:
    """The document of a row; null doc_ids are one that comes last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))


def _row_key(who: Column) -> Column:
    return F.xxhash64("row_hash", "text_hash", who["none"], who["id"])


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, row_hash and text_hash (128 bits of the text), doc, a hash of doc_id that is never null, and key, one of the row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_hash"), F.xxhash64(F.lit(6), "text").alias("text_hash"))
    return rows.select("*", F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias("doc"), _row_key(_who()).alias("key"))


def _first(batches: Iterator[pa.RecordBatch], firsts: bytes) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """Chunks of the rows (key, text, ...) whose key is among the first rows of their texts: batch of these, place in it, encoded texts."""
    for b in batches:
        b = b.filter(pa.array(passes(firsts, b.column(0).to_numpy(zero_copy_only=False))))
        for at, encoded in chunks(b.column(1).to_pylist(), HELD):
            yield b, at, encoded


def _postings(docs: DataFrame, firsts: Broadcast) -> DataFrame:
    """Packed postings: of bands by paragraph, and of whole paragraphs and stretches by document, of which only the repeated keys are wanted."""
    bits = bucket_bits(int((docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 8))  # about so many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for b, at, encoded in _first(batches, firsts.value):
            ids = b.column(2).to_numpy(zero_copy_only=False)
            p, place = Paragraphs(encoded), place + 1
            keys, which = p.band_keys()
            yield pack(keys, p.digest[0][which], bits, place)
            start, hashes = stretches(p.words)
            doc = np.searchsorted(p.words.bounds, start, "right") - 1
            yield pack(np.concatenate([p.digest[0], hashes]), ids[np.concatenate([p.doc, doc]) + at], bits, place, alone=True)

    return arrow(docs.select("key", "text", "doc"), run, PACKED)


def long_enough(first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray, least: int) -> np.ndarray:
    """Which pieces (word ranges within documents low:high, that may grow by reach to both sides) are in a row of touching ones of least words, once all have grown."""
    start, end = np.maximum(first - reach, low), np.minimum(last + reach, high)
    order = np.lexsort((end, start))
    start, end, low = start[order], end[order], low[order]
    far = np.maximum.accumulate(end) if len(end) else end
    new = np.concatenate([[True], (start[1:] > far[:-1]) | (low[1:] != low[:-1])])[: len(start)]
    run = np.cumsum(new) - 1
    size = np.maximum.reduceat(end, np.flatnonzero(new)) - start[new] if len(start) else start
    out = np.zeros(len(order), bool)
    out[order] = (size >= least)[run]
    return out


def covered(first: np.ndarray, last: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Which of the word ranges first:last lie within touching stretches of some size, given their first words in order."""
    if not len(start):
        return np.zeros(len(first), bool)
    open_at = np.concatenate([[True], np.diff(start) > size])
    left = start[open_at]
    right = np.append(start[np.flatnonzero(open_at)[1:] - 1], start[-1]) + size
    at = np.searchsorted(left, first, "right") - 1
    return (at >= 0) & (last <= right[np.maximum(at, 0)])


def _hits(docs: DataFrame, firsts: Broadcast, pairs: DataFrame, repeated: DataFrame, least: int) -> DataFrame:
    """What may be repeated in docs: doc_id, row_hash, word (the first one's index), n_words, place, end, d1, d2 and tokens.

    Paragraphs have their digest as d1 and d2 and, if they may be in pairs, tokens once a task; stretches
    have d1 alone, and whole texts of least words neither d1 nor, in its place, anything but text_hash as
    d2. Left out are pieces that can't be in a passage of least words, whatever is verified, and
    paragraphs within repeated stretches, but for those of two documents a task that others may be near.
    """
    sc = docs.sparkSession.sparkContext
    near = pairs.select("node").union(pairs.select("hub")).distinct()
    joined, again = (sc.broadcast(filter_of(x)) for x in (near, repeated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int] = {}  # paragraphs that this task has returned, with a document, anew when they are many
        for b, at, encoded in _first(batches, firsts.value):
            ids = b.column(5).to_numpy(zero_copy_only=False)
            p = Paragraphs(encoded)
            w, points = p.words, code_points(p.words)
            linked = passes(joined.value, p.digest[0])
            some = np.flatnonzero(linked | passes(again.value, p.digest[0]))
            start, hashes = stretches(w)
            which = np.flatnonzero(passes(again.value, hashes))
            start, hashes = start[which], hashes[which]
            doc = np.concatenate([p.doc[some], np.searchsorted(w.bounds, start, "right") - 1])
            first, last = np.concatenate([p.first[some], start]), np.concatenate([p.last[some], start + STRETCH])
            keep = long_enough(first, last, w.bounds[doc], w.bounds[doc + 1], np.repeat([0, STRETCH], [len(some), len(start)]), least)
            inside = covered(p.first[some], p.last[some], start, STRETCH)
            tokens: list = [None] * len(doc)
            for j, i in enumerate(some.tolist()):
                if not keep[j] or not linked[i]:
                    keep[j] &= not inside[j]
                    continue
                name, of = int(p.digest[0][i]), int(ids[p.doc[i] + at])
                if name not in sent:
                    tokens[j] = p.sets([i])[0]
                    sent[name] = of
                elif sent[name] is not None and sent[name] != of:
                    sent[name] = None  # a second document
                else:
                    keep[j] &= not inside[j]
            if len(sent) > 200_000:
                sent.clear()
            kept = np.flatnonzero(keep)
            whole = np.flatnonzero(np.diff(w.bounds) >= least)
            doc, first, last = np.concatenate([doc[kept], whole]), np.concatenate([first[kept], w.bounds[whole]]), np.concatenate([last[kept], w.bounds[whole + 1]])
            base = points[w.offset[:-1]][doc]
            none = [None] * len(whole)
            names = [*p.digest[0][some].tolist(), *hashes.tolist()], [*p.digest[1][some].tolist(), *[None] * len(start)]
            d1, d2 = ([n[i] for i in kept.tolist()] for n in names)
            rows = pa.array(doc + at)
            numbers = (first - w.bounds[doc], last - first, points[w.start[first]] - base, points[w.end[last - 1]] - base)
            yield pa.RecordBatch.from_arrays(
                [b.column(2).take(rows), b.column(3).take(rows), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array([*d1, *none], pa.int64()), pa.array([*d2, *b.column(4).take(pa.array(whole + at)).to_pylist()], pa.int64()), pa.array([tokens[i] for i in kept.tolist()] + none, pa.list_(pa.int64()))],
                ["doc_id", "row_hash", "word", "n_words", "place", "end", "d1", "d2", "tokens"],
            )

    return arrow(docs.select("key", "text", "doc_id", "row_hash", "text_hash", "doc"), run, "doc_id long, row_hash long, word long, n_words long, place long, end long, d1 long, d2 long, tokens array<long>")


def _sides(docs: DataFrame, firsts: Broadcast, edges: DataFrame) -> DataFrame:
    """What stands beside all occurrences of the stretches of edges (row_hash, word, d1, side: 0 before, 1 after): doc_id, row_hash, word, d1, side, words, places.

    words are the hashes of up to STRETCH words, nearest first; places, the code points where these
    start (before) or end (after), are there for the edges themselves.
    """
    sc = docs.sparkSession.sparkContext
    held = [sc.broadcast(filter_of(edges.filter(F.col("side") == k).select("d1").distinct())) for k in (0, 1)]
    spots = sc.broadcast(filter_of(edges.select(F.col("row_hash").bitwiseXOR(F.col("word") * 2 + F.col("side")).alias("spot"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, encoded in _first(batches, firsts.value):
            w = Words(encoded)
            every, hashes = stretches(w)
            found = [np.flatnonzero(passes(held[k].value, hashes)) for k in (0, 1)]
            if not sum(map(len, found)):
                continue
            points, short = code_points(w), (w.hash >> U(33)).astype(np.int32)
            start, names = (np.concatenate([x[f] for f in found]) for x in (every, hashes))
            side = np.repeat([0, 1], [len(f) for f in found])
            doc = np.searchsorted(w.bounds, start, "right") - 1
            word = start - w.bounds[doc]
            own = passes(spots.value, b.column(3).to_numpy(zero_copy_only=False)[doc + at] ^ (word * 2 + side))
            words, places = [], []
            for s, d, k, mine in zip(start.tolist(), doc.tolist(), side.tolist(), own.tolist(), strict=True):
                near = slice(s + STRETCH, min(s + 2 * STRETCH, w.bounds[d + 1])) if k else slice(max(s - STRETCH, w.bounds[d]), s)
                turn = 1 if k else -1
                words.append(short[near][::turn])
                places.append((points[(w.end if k else w.start)[near]][::turn] - points[w.offset[d]]).astype(np.int32) if mine else None)
            rows = pa.array(doc + at)
            yield pa.RecordBatch.from_arrays(
                [b.column(2).take(rows), b.column(3).take(rows), pa.array(word), pa.array(names), pa.array(side), *(pa.array(x, pa.list_(pa.int32())) for x in (words, places))],
                ["doc_id", "row_hash", "word", "d1", "side", "words", "places"],
            )

    found = arrow(docs.select("key", "text", "doc_id", "row_hash"), run, "doc_id long, row_hash long, word long, d1 long, side long, words array<int>, places array<int>")
    return found.join(few(edges.select("d1", "side").distinct()), ["d1", "side"], "left_semi")


def _same(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y), True)
    return F.when(apart > 0, apart - 1).otherwise(n.cast("long"))


def _shared_sides(sides: DataFrame) -> DataFrame:
    """d1, side, words and ``more``: how many of these words another document has there too.

    What stands on a side is grouped first, so that a stretch of any number of documents has a row for
    each different side. In the order of sides the longest common part is a neighbour's; two to either
    direction are seen, so that a document's own other occurrences don't hide it.
    """
    doc = F.xxhash64(F.col("doc_id").isNull(), "doc_id")
    each = sides.filter(F.size("words") > 0).groupBy("d1", "side", "words").agg(F.min(doc).alias("low"), F.max(doc).alias("high"))
    w = Window.partitionBy("d1", "side", F.get("words", F.lit(0))).orderBy("words")
    near = [tuple(f(c, k).over(w) for c in ("words", "low", "high")) for f in (F.lag, F.lead) for k in (1, 2)]
    other = [F.when((low != F.col("low")) | (high != F.col("low")), _same(F.col("words"), words)).otherwise(0) for words, low, high in near]
    more = F.when(F.col("low") != F.col("high"), F.size("words")).otherwise(F.greatest(F.lit(0), *other))
    return each.select("d1", "side", "words", more.cast("int").alias("more")).filter("more > 0")


def repeated_pieces(docs: DataFrame, least: int = MIN_WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Repeated pieces of texts, and the texts that several documents have.

    Pieces: doc_id, row_hash, word (the first one's index), n_words, place and end (code points),
    component, keep and whole of every repeated paragraph and stretch, in the first document of each text.
    A paragraph is repeated if more than one document has its cluster, a stretch if more than one has it;
    paragraphs within repeated stretches may be left out. keep is true for the cluster's first piece, by
    document, text and position; whole is false for words next to a stretch that another document shares
    there, which have no cluster of their own. Pieces that can't be in a passage of least words count
    nowhere. Texts: doc_id, row_hash, place, end, n_words and first (in the first document) of each row,
    from least words. A null text has no words; null doc_ids are one document that comes last; repeated
    rows are the same pieces.
    """
    docs = _rows(docs)
    ids = written(docs.select("doc_id", "row_hash", "text_hash"))
    once = (lambda df: df) if ids.count() == ids.distinct().count() else (lambda df: df.distinct())  # rows may be alike
    texts = ids.groupBy("row_hash", "text_hash").agg(F.min(_who()).alias("low"), F.max(_who()).alias("high"))
    firsts = docs.sparkSession.sparkContext.broadcast(filter_of(texts.select(_row_key(F.col("low")).alias("key"))))  # others that pass are done again, for nothing
    shared = written(shared_keys(_postings(docs, firsts)))
    pairs, repeated = shared.filter("node IS NOT NULL"), shared.filter("node IS NULL").select(F.col("hub").alias("key"))
    hits = written(_hits(docs, firsts, pairs, repeated, least))
    many = hits.filter("d1 IS NULL").select("row_hash", F.col("d2").alias("text_hash"), "place", "end", "n_words").distinct().join(texts.filter("low <> high").select("row_hash", "text_hash", "low"), ["row_hash", "text_hash"])
    many = once(ids).join(many, ["row_hash", "text_hash"]).select("doc_id", "row_hash", "place", "end", "n_words", (_who() == F.col("low")).alias("first"))
    hits = hits.filter("d1 IS NOT NULL")
    placed = once(hits.drop("tokens"))
    named = written(hits.filter("tokens IS NOT NULL").groupBy("d1", "d2").agg(F.first("tokens").alias("tokens")).withColumn("name", F.monotonically_increasing_id()))
    found = cluster(pairs, lambda nodes: named.select("name", F.col("d1").alias("node"), "tokens").join(nodes, "node", "left_semi"), num, den, block)
    top = named.select(F.col("name").alias("label"), F.col("d1").alias("c1"), F.col("d2").alias("c2"))
    cluster_of = few(found.join(named.select(F.col("name").alias("node"), "d1", "d2"), "node").join(top, "label").select("d1", "d2", "c1", "c2"), CLUSTERS)
    own = ["doc_id", "row_hash", "word", "n_words", "place", "end"]
    paragraphs = placed.filter("d2 IS NOT NULL").select(*own, "d1", "d2").join(cluster_of, ["d1", "d2"], "left").select(*own, F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"), F.lit(False).alias("stretch"))
    pieces = paragraphs.union(placed.filter("d2 IS NULL").select(*own, F.col("d1").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(True).alias("stretch")))
    # clusters of several documents by numbers alone; where in its first document a cluster begins, for these
    none, key = F.col("doc_id").isNull(), ["c1", "c2", "stretch"]
    both = few(pieces.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bool_or(none).alias("none")).filter("low <> high OR none AND low IS NOT NULL").select(*key, "low"), CLUSTERS)
    again = written(pieces.join(both, key))
    place = F.struct("row_hash", "word")
    first = few(again.filter(F.col("doc_id") == F.col("low")).groupBy(*key).agg(F.min(place).alias("first")), CLUSTERS)
    keep = (F.col("doc_id") == F.col("low")) & (place == F.col("first"))
    whole = again.join(first, key).select(*own, F.col("c1").alias("component"), F.coalesce(keep, F.lit(False)).alias("keep"), F.lit(True).alias("whole"))
    # stretches that begin or end a row of them in some document grow there
    w = Window.partitionBy("doc_id", "row_hash").orderBy("word")
    reach = F.col("word") + F.col("n_words")
    open_ends = F.array(F.when(F.coalesce(F.lag(reach).over(w) < F.col("word"), F.lit(True)), 0), F.when(F.coalesce(F.lead("word").over(w) > reach, F.lit(True)), 1)).cast("array<bigint>")
    ended = again.filter("stretch").select("doc_id", "row_hash", "word", "place", "end", F.col("c1").alias("d1"), open_ends.alias("ends"))
    edges = written(ended.select("*", F.explode(F.array_compact("ends")).alias("side")).drop("ends"))
    sides = written(_sides(docs, firsts, edges))
    grown = sides.filter("places IS NOT NULL").join(_shared_sides(sides), ["d1", "side", "words"]).select("row_hash", "word", "d1", "side", "more", "places").distinct()
    grown = edges.join(grown, ["row_hash", "word", "d1", "side"])
    before, outer = F.col("side") == 0, F.get("places", F.col("more") - 1).cast("long")
    grown = grown.select(
        "doc_id",
        "row_hash",
        F.when(before, F.col("word") - F.col("more")).otherwise(F.col("word") + STRETCH).alias("word"),
        F.col("more").cast("long").alias("n_words"),
        F.when(before, outer).otherwise(F.col("end")).alias("place"),
        F.when(before, F.col("place")).otherwise(outer).alias("end"),
        F.lit(None).cast("long").alias("component"),
        F.lit(None).cast("boolean").alias("keep"),
        F.lit(False).alias("whole"),
    )
    return whole.union(grown), many


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """A row for each passage: doc_id, start and end (code points), n_words, n_pieces, n_removed (those that aren't the first of their cluster) and components (sorted, distinct).

    A passage is a text that another document has too, or a row of repeated pieces that touch or overlap,
    of min_words words at least from the first to the last. Rows that are alike have it once.
    """
    p, many = repeated_pieces(docs, min_words, num, den, block)
    many = written(many)
    order = Window.partitionBy("doc_id", "row_hash").orderBy("word", "end", "component")
    reach = F.col("word") + F.col("n_words")
    new = p.select("*", F.coalesce((F.col("word") > F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)).alias("new"))
    runs = new.select("*", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    out = runs.groupBy("doc_id", "row_hash", "run").agg(
        F.min("place").alias("start"),
        F.max("end").alias("end"),
        (F.max(reach) - F.min("word")).alias("n_words"),
        F.count_if("whole").alias("n_pieces"),
        F.count_if(~F.col("keep")).alias("n_removed"),
        F.sort_array(F.collect_set("component")).alias("components"),
    )
    out = out.filter(F.col("n_words") >= min_words).join(many.select("row_hash").distinct(), "row_hash", "left_anti").drop("row_hash", "run")
    whole = many.select("doc_id", F.col("place").alias("start"), "end", "n_words", F.lit(1).cast("long").alias("n_pieces"), F.when(F.col("first"), 0).otherwise(1).cast("long").alias("n_removed"), F.array("row_hash").alias("components"))
    return out.unionByName(whole)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
