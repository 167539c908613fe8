"""Hard-negative mining over a pivot table.

A component more, chosen so that all rows have the length of the longest, turns the inner product with
an anchor into a Euclidean distance: |a - x|^2 = |a|^2 + M^2 - 2 a.x. Every row keeps its distances to a
few pivots; by the triangle inequality these and the anchor's own distances to them bracket the
row's score, for whole stretches of neighbouring rows first. Rows whose bracket holds no score that
could still matter are never multiplied; the survivors' inner products are computed exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, table, written

#: Pivots, the rows of the sample that they are chosen from, and the anchors of a block (half as many by hash, so that none has more).
PIVOTS, SAMPLE, ANCHORS = 16, 2048, 4096
#: Rows that are bracketed as one first, and anchors that meet a stretch at a time.
STRETCH, GROUP = 256, 512
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between so many hundredths of the positive's and the positive's.
LOW, HIGH = 80, 100
EVERY, CLASSES, FLIPPED = 100, 10, 7
#: Sums below this are exact as doubles, whatever their order.
EXACT = float(2**53)


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (array of long) of rows that take part: label and vector are there and all components are finite.

    Labels of rows whose vec_id is divisible by FLIPPED become the next class; components become floor(256 x).
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("long")
    out = rows.select(F.col("vec_id").cast("long"), label.alias("label"), x.alias("x")).filter(F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(whole, F.lit(False)))
    label = F.when(F.col("vec_id") % FLIPPED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return out.select("vec_id", label.alias("label"), F.transform("x", lambda c: F.floor(c * 256.0)).alias("v"))


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


class Pivots:
    """Pivots of one dimension: points of the sample far from each other, with their added component."""

    def __init__(self, sample: np.ndarray, longest: float) -> None:
        self.longest = longest
        chosen, points = [], self.lifted(sample)
        far = np.full(len(points), np.inf)
        at = 0
        for _ in range(min(PIVOTS, len(points))):
            chosen.append(at)
            far = np.minimum(far, np.linalg.norm(points - points[at], axis=1))
            at = int(far.argmax())
        self.points = points[chosen]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of points with the added component to each pivot."""
        return np.sqrt(np.maximum((points * points).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1) - 2 * points @ self.points.T, 0))


def pivot_table(rows: DataFrame) -> tuple[DataFrame, dict[int, Pivots], np.ndarray, list]:
    """Rows (vec_id, label, v) with their pivot distances, written so that rows near the same pivot and at a like distance from it lie together; the pivots by dimension; and the sample.

    The sample is the SAMPLE rows of least hash of vec_id, so its size is bounded; it chooses pivots and
    gives anchors a first bound, and changes no result. A score must fit a long: rows too long for that are an error.
    """
    size = F.size("v")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    longest = {r["n"]: r["m"] for r in rows.groupBy(size.alias("n")).agg(F.max(square).alias("m")).collect()}  # a row for each dimension
    if any(m >= 2.0**63 for m in longest.values()):
        raise ValueError("components are too large: a score would not fit a long")
    sample = rows.withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id").limit(SAMPLE).drop("_h").collect()
    by = {n: np.array(x := [r["v"] for r in sample if len(r["v"]) == n], np.int64).reshape(len(x), n) for n in longest}
    pivots = {n: Pivots(by[n] if len(by[n]) else np.zeros((1, n), np.int64), m) for n, m in longest.items()}
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                part = b.filter(pa.array(sizes == n))
                p = sent.value[int(n)]
                d = p.distances(p.lifted(_matrix(part.column(2), part.num_rows) if n else np.zeros((part.num_rows, 0))))
                near = d.argmin(axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, max(d.shape[1], 1), dtype=np.int32)), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "label", "v", "d", "near", "own"])

    out = arrow(rows, run, "vec_id long, label long, v array<long>, d array<double>, near int, own double").withColumn("n", size)
    keys = ["n", "near", "own", "vec_id"]
    return written(out.repartitionByRange(*keys).sortWithinPartitions(*keys)), pivots, sample


class _Best:
    """The first k ids by falling score, then id, each once: as they come."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """A score below this can't enter."""
        return int(self.scores[-1]) if len(self.ids) == self.k else -(2**63)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.ids) == self.k and scores.max() <= self.scores[-1] and (scores.max() < self.scores[-1] or ids.min() > self.ids[-1]):
            return
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        _, first = np.unique(i, return_index=True)
        keep = np.sort(first)[: self.k]
        self.scores, self.ids = s[keep], i[keep]


class _Scan:
    """Blocks of anchors against rows as they pass: which score ranges each anchor still looks for, and the exact scores within them."""

    def __init__(self, pivots: Pivots, anchors: dict) -> None:
        self.p, self.a = pivots, anchors
        x = anchors["v"].astype(np.float64)
        self.points = np.column_stack([x, np.zeros(len(x))])
        self.square = (x * x).sum(axis=1)
        self.d = pivots.distances(self.points)
        self.slack = 1e-9 * (self.square + pivots.longest) + 1e-6

    def brackets(self, near: np.ndarray, far: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most score of rows whose pivot distances lie between these (rows x pivots) with anchors ``on``: anchors x rows."""
        low, high = np.zeros((len(on), len(near))), np.full((len(on), len(near)), np.inf)
        for j in range(near.shape[1]):
            d = self.d[on, j][:, None]
            np.maximum(low, d - far[:, j], out=low)
            np.maximum(low, near[:, j] - d, out=low)
            np.minimum(high, d + far[:, j], out=high)
        total, slack = (self.square[on] + self.p.longest)[:, None], self.slack[on][:, None]
        return (total - high * high) / 2 - slack, (total - low * low) / 2 + slack

    def scores(self, rows: np.ndarray, on: np.ndarray) -> np.ndarray:
        a = self.a["v"][on]
        if self.p.longest + float(self.square.max(initial=0)) < EXACT:
            return (a.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return a @ rows.T


def _scan(stored: DataFrame, sent: Broadcast, pivots: dict[int, Pivots], prepare: Callable, schema: str) -> DataFrame:
    """Rows of ``schema``: what ``prepare(scan)``, which says which brackets it wants and takes the survivors' scores, has found at the end of a task."""
    shared = stored.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for b in batches:
            sizes = b.column(4).to_numpy()
            for n in np.unique(sizes):
                n = int(n)
                if n not in sent.value:
                    continue
                if n not in found:
                    found[n] = prepare(_Scan(shared.value[n], sent.value[n]))
                part = b.filter(pa.array(sizes == n))
                m = part.num_rows
                v, d = _matrix(part.column(2), m).reshape(m, n), _matrix(part.column(3), m)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                look = found[n]
                for at in range(0, m, STRETCH):
                    s = slice(at, at + STRETCH)
                    near, far = d[s].min(axis=0)[None], d[s].max(axis=0)[None]
                    for first in range(0, len(look.scan.square), GROUP):
                        on = np.arange(first, min(first + GROUP, len(look.scan.square)))
                        on = on[look.wanted(on, *look.scan.brackets(near, far, on))[:, 0]]
                        if not len(on):
                            continue
                        may = look.wanted(on, *look.scan.brackets(d[s], d[s], on))
                        rows = np.flatnonzero(may.any(axis=0))
                        if len(rows):
                            on, may = on[may.any(axis=1)], may[may.any(axis=1)][:, rows]
                            look.offer(on, look.scan.scores(v[s][rows], on), may, ids[s][rows], labels[s][rows])
        for look in found.values():
            yield look.rows()

    return arrow(stored.select("vec_id", "label", "v", "d", "n"), run, schema)


class _Positives:
    """For each anchor the best other rows of its label."""

    def __init__(self, scan: _Scan, k: int) -> None:
        self.scan, self.best, self.k = scan, [_Best(k) for _ in scan.a["id"]], k
        self.least = scan.a["floor"].copy()

    def wanted(self, on: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= self.least[on][:, None]

    def offer(self, on: np.ndarray, scores: np.ndarray, may: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        a = self.scan.a
        ok = may & (labels == a["label"][on][:, None]) & (ids != a["id"][on][:, None]) & (scores >= self.least[on][:, None])
        for i in np.flatnonzero(ok.any(axis=1)):
            best = self.best[on[i]]
            best.add(scores[i, ok[i]], ids[ok[i]])
            self.least[on[i]] = max(self.least[on[i]], best.floor())

    def rows(self) -> pa.RecordBatch:
        a = self.scan.a["id"]
        n = [len(b.ids) for b in self.best]
        cat = lambda f: np.concatenate([f(b) for b in self.best]) if self.best else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(a, n)), pa.array(cat(lambda b: b.ids)), pa.array(cat(lambda b: b.scores))], ["anchor_id", "positive_id", "positive_score"])


class _Negatives:
    """For each anchor and positive the best rows of other labels within the positive's range. Equal positive scores share a list."""

    def __init__(self, scan: _Scan, k: int, low: int, high: int) -> None:
        self.scan, self.k = scan, k
        self.ranges = [sorted({int(s): (-(-low * int(s) // 100), high * int(s) // 100) for s in scores}.items()) for scores in scan.a["positives"]]
        self.best = [[_Best(k) for _ in r] for r in self.ranges]
        self.bottom = np.array([min((b for _, (b, _) in r), default=2**63 - 1) for r in self.ranges], np.int64)
        self.top = np.array([max((t for _, (_, t) in r), default=-(2**63)) for r in self.ranges], np.int64)

    def wanted(self, on: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (high >= self.bottom[on][:, None]) & (low <= self.top[on][:, None])

    def offer(self, on: np.ndarray, scores: np.ndarray, may: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        other = may & (labels != self.scan.a["label"][on][:, None]) & (scores >= self.bottom[on][:, None]) & (scores <= self.top[on][:, None])
        for i in np.flatnonzero(other.any(axis=1)):
            s, x, k = scores[i, other[i]], ids[other[i]], on[i]
            for (_, (bottom, top)), best in zip(self.ranges[k], self.best[k], strict=True):
                ok = (s <= top) & (s >= max(bottom, best.floor()))
                if ok.any():
                    best.add(s[ok], x[ok])
            # a row below the k-th best of every range is of no more use
            self.bottom[k] = min(max(b, best.floor()) for (_, (b, _)), best in zip(self.ranges[k], self.best[k], strict=True))

    def rows(self) -> pa.RecordBatch:
        out = [(a, s, i, t) for a, ranges, lists in zip(self.scan.a["id"].tolist(), self.ranges, self.best, strict=True) for (s, _), b in zip(ranges, lists, strict=True) for i, t in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["anchor_id", "positive_score", "negative_id", "negative_score"])


def _floors(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, sample: list, k: int) -> np.ndarray:
    """A score that at least k other rows of an anchor's label reach, by the sample; the least long where it holds fewer."""
    same = [r for r in sample if len(r["v"]) == v.shape[1]]
    out = np.full(len(ids), -(2**63), np.int64)
    if same:
        x, s_id, s_label = np.array([r["v"] for r in same], np.int64).reshape(len(same), -1), np.array([r["vec_id"] for r in same]), np.array([r["label"] for r in same])
        for i in range(len(ids)):
            ok = (s_label == labels[i]) & (s_id != ids[i])
            if len(set(s_id[ok].tolist())) >= k:
                _, first = np.unique(s_id[ok], return_index=True)
                out[i] = np.sort(x[ok][first] @ v[i])[-k]
    return out


def _first(rows: DataFrame, by: list[str], id: str, score: str, k: int) -> DataFrame:
    """The first k ids by score (an id's best counts) and id, with ``rank`` from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), id)
    return rows.groupBy(*by, id).agg(F.max(score).alias(score)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, chosen: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (vec_id, label, v: array of long, none of them null).

    Anchors are the rows that ``chosen`` takes, by default those whose vec_id is divisible by EVERY; they
    go through in blocks of at most ANCHORS, the stated query set, each against all rows. A vector meets
    those of its own dimension. Of equal scores the smaller vec_id comes first; repeated rows count once,
    and a vec_id that has several rows counts with its best score (as an anchor: with its least label and
    vector). An empty table, or an anchor without positives or negatives, gives no rows. Other columns
    aren't looked at.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "v")
    stored, pivots, sample = pivot_table(rows)
    pick = F.col("vec_id") % EVERY == 0 if chosen is None else chosen
    anchors = written(stored.filter(pick).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"))
    blocks = -(-anchors.count() // (ANCHORS // 2))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for i in range(blocks):
        asked = anchors.filter(block == i).collect()  # about half of ANCHORS vectors
        mine = {}
        for n in {len(r["v"]) for r in asked}:
            own = [r for r in asked if len(r["v"]) == n]
            ids, labels, v = np.array([r["vec_id"] for r in own]), np.array([r["label"] for r in own]), np.array([r["v"] for r in own], np.int64).reshape(len(own), n)
            mine[n] = {"id": ids, "label": labels, "v": v, "floor": _floors(ids, labels, v, sample, positives)}
        sent = spark.sparkContext.broadcast(mine)
        best = written(_first(_scan(stored, sent, pivots, lambda s: _Positives(s, positives), "anchor_id long, positive_id long, positive_score long"), ["anchor_id"], "positive_id", "positive_score", positives).drop("rank"))
        scores: dict[int, list] = {}
        for r in best.select("anchor_id", "positive_score").collect():  # a few for each anchor of the block
            scores.setdefault(r["anchor_id"], []).append(r["positive_score"])
        again = spark.sparkContext.broadcast({n: m | {"positives": [scores.get(a, []) for a in m["id"].tolist()]} for n, m in mine.items()})
        found = _scan(stored, again, pivots, lambda s: _Negatives(s, negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
        ranked = _first(found, ["anchor_id", "positive_score"], "negative_id", "negative_score", negatives)
        out = out.unionByName(written(best.join(ranked, ["anchor_id", "positive_score"]).select(*out.columns)))
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantised(table(spark, sf_dir, "embeddings")))


SQL = {
    "op11_hard_negatives": f"""
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % {FLIPPED} = 0 THEN (label::BIGINT + 1) % {CLASSES} ELSE label::BIGINT END AS label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM x a JOIN x r ON a.vec_id % {EVERY} = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * s.score AND s.score * 100 <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
}
