"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is given by a hashed word vector and the mean of hashed vectors of its character n-grams.
A window of words runs through a GRU in both directions; attention over its states gives the
window's logit, and the highest of all overlapping windows of a text is the text's. Labels belong
to whole texts, so training pools the logits of all of a text's windows by a smooth maximum. Fitting
takes place on the driver, on at most POSITIVES and NEGATIVES labelled texts of CHARS characters in
all; scoring covers every word of every text, in windows that start at every STRIDE-th word.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, table
from .textnum import ALNUM, U, Words, chunks, mix

f32 = np.float32
#: Bounds of the fitted sample (rows with the lowest hash of doc_id): texts of each label, and characters of each label's.
POSITIVES, NEGATIVES, CHARS = 1200, 2800, 16_000_000
#: The z-score from which a word's or n-gram's lean to label 1 counts before fitting.
CERTAIN = 2.6
#: From so many texts on, counting has less to say.
SPARSE = 400
#: Windows that are held with their gradients at a time.
HELD = 4096
#: Window length and step in words, sizes of a state and of the two vectors, rows of their tables.
LENGTH, STRIDE, STATE, WORD, CHAR, WORD_ROWS, CHAR_ROWS = 24, 12, 8, 8, 8, 1 << 15, 1 << 15
EPOCHS, BATCH, RATE, SHARP, SEED = 6, 48, 0.01, 4.0, 3
#: Lengths of word starts and of inner character n-grams, in bytes.
STARTS, INNER = (3, 4, 5, 6, 7, 8), 4
PREDICT = 0.3


@dataclass
class Vocabulary:
    """The distinct words of some texts: rows of the word table; rows of the character table, word by word, with their bounds; and which word each place has."""

    word: np.ndarray
    chars: np.ndarray
    bounds: np.ndarray
    place: np.ndarray


def vocabulary(words: Words) -> Vocabulary:
    keys, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
    start, size = words.start[first], words.end[first] - words.start[first]
    data = words.data.astype(U)
    rows, of = [], []
    for n in STARTS:
        long = np.flatnonzero(size >= n)
        rows.append(_ngrams(data, start[long], n, n))
        of.append(long)
    # inner n-grams of the whole word, however long
    count = np.maximum(size - INNER + 1, 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    rows.append(_ngrams(data, np.repeat(start - ends[:-1], count) + np.arange(ends[-1]), INNER, 99))
    of.append(np.repeat(np.arange(len(keys)), count))
    of, rows = np.concatenate(of), np.concatenate(rows)
    order = np.argsort(of, kind="stable")
    return Vocabulary((keys & U(WORD_ROWS - 1)).astype(np.int32), rows[order], np.searchsorted(of[order], np.arange(len(keys) + 1)), place.reshape(-1))


def _ngrams(data: np.ndarray, start: np.ndarray, n: int, seed: int) -> np.ndarray:
    h = np.full(len(start), seed, U)
    for k in range(n):
        h = h * U(257) + data[start + k]
    return (mix(h) & U(CHAR_ROWS - 1)).astype(np.int32)


def window_starts(n: int) -> np.ndarray:
    """The first words of all windows over n words: every STRIDE words, the last reaching the end; one, empty, over none."""
    return np.arange(0, max(n - LENGTH, 0) + STRIDE, STRIDE) if n > LENGTH else np.zeros(1, np.int64)


def _summed(to: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the sum of the rows that go to it."""
    out = np.zeros((n, rows.shape[1]), f32)
    if len(to):
        order = np.argsort(to, kind="stable")
        first = np.flatnonzero(np.diff(to[order], prepend=-1))
        out[to[order][first]] = np.add.reduceat(rows[order], first)
    return out


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        init = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(f32)
        x, h = WORD + CHAR, STATE
        self.p = {"ew": init(WORD_ROWS, WORD, scale=0.1), "ec": init(CHAR_ROWS, CHAR, scale=0.1), "a": init(2 * h, scale=0.3), "w": init(2 * h, scale=0.5), "b": np.full(1, -1.5, f32)}
        for d in "fb":
            self.p |= {f"x{d}": init(x, 3 * h, scale=x**-0.5), f"u{d}": init(h, 3 * h, scale=h**-0.5), f"c{d}": np.zeros(3 * h, f32)}

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """The vectors of the distinct words, and a last one of zeros for places after the end."""
        n = np.diff(v.bounds)
        chars = _summed(np.repeat(np.arange(len(n)), n), self.p["ec"][v.chars], len(n))
        x = np.concatenate([self.p["ew"][v.word], chars / np.sqrt(np.maximum(n, 1, dtype=f32))[:, None]], axis=1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), f32)])

    def _run(self, proj: np.ndarray, at: np.ndarray, live: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (steps, windows, STATE) of one direction; at: the word of each place by window, live: whether there is one."""
        h, u, n = np.zeros((len(at), STATE), f32), self.p[f"u{d}"], STATE
        out = np.empty((at.shape[1], len(at), n), f32)
        whole = bool(live.all())
        for t in range(at.shape[1]) if d == "f" else range(at.shape[1] - 1, -1, -1):
            a, g = proj[at[:, t]], h @ u
            zr = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * n] + g[:, : 2 * n]))
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            new = c + z * (h - c)
            if not whole:
                new = np.where(live[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * n :]))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, at: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        states = []
        for d in "fb":
            steps = None if keep is None else keep.setdefault(d, [])
            states.append(self._run(x @ self.p[f"x{d}"] + self.p[f"c{d}"], at, live, d, steps))
        s = np.concatenate(states, axis=2)
        e = np.where(live.T, s @ self.p["a"], f32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e * live.T / np.maximum((e * live.T).sum(axis=0), f32(1e-9))
        pooled = np.einsum("tb,tbh->bh", alpha, s)
        if keep is not None:
            keep |= {"s": s, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, v: Vocabulary, x: np.ndarray, at: np.ndarray, live: np.ndarray, keep: dict, by_logit: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all parameters, given that of each window's logit."""
        p, n, s, alpha = self.p, STATE, keep["s"], keep["alpha"]
        g = {"w": keep["pooled"].T @ by_logit, "b": by_logit.sum(keepdims=True)}
        by_pooled = by_logit[:, None] * p["w"]
        by_alpha = np.einsum("bh,tbh->tb", by_pooled, s)
        by_e = alpha * (by_alpha - (alpha * by_alpha).sum(axis=0))
        by_s = alpha[..., None] * by_pooled + by_e[..., None] * p["a"]
        g["a"] = np.einsum("tb,tbh->h", by_e, s)
        by_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            by_h, by_u, by_steps = np.zeros((len(at), n), f32), np.zeros_like(p[f"u{d}"]), np.empty((at.shape[1], len(at), 3 * n), f32)
            for t, h, z, r, c, gc in reversed(keep[d]):
                by_h = by_h + by_s[t, :, k * n : (k + 1) * n]
                on = live[:, t, None]
                through = np.where(on, 0, by_h)
                b = np.where(on, by_h, 0)
                by_c = b * (1 - z) * (1 - c * c)
                by_z = b * (h - c) * z * (1 - z)
                by_r = by_c * gc * r * (1 - r)
                by_steps[t] = np.concatenate([by_z, by_r, by_c], axis=1)
                by_g = np.concatenate([by_z, by_r, by_c * r], axis=1)
                by_u += h.T @ by_g
                by_h = through + b * z + by_g @ p[f"u{d}"].T
            by_proj = _summed(at.T.reshape(-1), by_steps.reshape(-1, 3 * n), len(x))
            g |= {f"u{d}": by_u, f"x{d}": x.T @ by_proj, f"c{d}": by_proj.sum(axis=0)}
            by_x += by_proj @ p[f"x{d}"].T
        by_x = by_x[:-1]
        g["ew"] = _summed(v.word, by_x[:, :WORD], WORD_ROWS)
        n = np.diff(v.bounds)
        by_char = by_x[:, WORD:] / np.sqrt(np.maximum(n, 1, dtype=f32))[:, None]
        g["ec"] = _summed(v.chars, by_char[np.repeat(np.arange(len(n)), n)], CHAR_ROWS)
        return g


def windows_of(words: Words, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word of each place of every window, whether there is one, and the bounds of each text's windows."""
    starts, lengths, count = [], [], []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        s = window_starts(b - a)
        starts.append(s + a)
        lengths.append(np.minimum(LENGTH, b - a - s))
        count.append(len(s))
    start, length = np.concatenate(starts), np.maximum(np.concatenate(lengths), 0)
    live = np.arange(LENGTH) < length[:, None]
    place = np.append(v.place, len(v.word))  # the last stands for no word
    at = place[np.where(live, start[:, None] + np.arange(LENGTH), len(place) - 1)]
    return at, live, np.concatenate([[0], np.cumsum(count)])


def evidence(encoded: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """How far more often each row of the word and the character table occurs in texts of label 1: the z-score of the log-odds of texts that have it, above CERTAIN."""
    counts = {"ew": np.zeros((2, WORD_ROWS)), "ec": np.zeros((2, CHAR_ROWS))}
    for b, y in zip(encoded, labels.tolist(), strict=True):
        v = vocabulary(Words([b], ALNUM))
        counts["ew"][y][np.unique(v.word)] += 1
        counts["ec"][y][np.unique(v.chars)] += 1
    n = np.bincount(labels, minlength=2) + 1.0
    z = lambda c: (np.log((c[1] + 0.5) / n[1]) - np.log((c[0] + 0.5) / n[0])) / np.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5))
    return {k: np.maximum(z(c) - CERTAIN, 0).astype(f32) for k, c in counts.items()}


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted by Adam to the labels of texts, the same for the same input; with one label alone it stays near that."""
    net, rng = Network(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    # one number of each vector begins with what counting tells, the less the more texts there are to learn from
    for k, e in evidence(encoded, labels).items():
        net.p[k][:, 0] += f32(0.5 * min(1, SPARSE / max(len(texts), 1))) * e
    # long and short epochs on few texts see as many batches
    rounds = min(epochs * max(1, round(2000 / max(len(texts), 1))), 4 * epochs)
    total, step = rounds * -(-len(texts) // BATCH), 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            grads = text_gradients(net, [encoded[k] for k in rows], labels[rows])
            step += 1
            rate = RATE * min(1, 3 * (1 - step / (total + 1)))
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(f32)
    return net


def text_gradients(net: Network, encoded: list[bytes], labels: np.ndarray, held: int = HELD) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of some texts, all windows of each pooled by a smooth maximum.

    Windows go through twice, so that only ``held`` of them at a time are kept with what their
    gradients need: first for the logits, then, with the gradient of each, those that count.
    """
    words = Words(encoded, ALNUM)
    v = vocabulary(words)
    at, live, bounds = windows_of(words, v)
    x = net.inputs(v)
    proj = {d: x @ net.p[f"x{d}"] + net.p[f"c{d}"] for d in "fb"}
    z = np.concatenate([net_logits(net, proj, at[i : i + held], live[i : i + held]) for i in range(0, len(at), held)])
    low, count = bounds[:-1], np.diff(bounds)
    top = np.maximum.reduceat(z, low)
    e = np.exp(SHARP * (z - np.repeat(top, count)))
    total = np.add.reduceat(e, low)
    pooled = top + np.log(total) / SHARP
    by_text = (1 / (1 + np.exp(-pooled)) - labels.astype(f32)) / len(encoded)
    by_logit = (np.repeat(by_text / total, count) * e).astype(f32)
    some = np.flatnonzero(e > 1e-6)  # what is less is nothing beside the text's highest window
    out: dict[str, np.ndarray] = {}
    for i in range(0, len(some), held):
        w, keep = some[i : i + held], {}
        net.logits(x, at[w], live[w], keep)
        for k, g in net.gradients(v, x, at[w], live[w], keep, by_logit[w]).items():
            out[k] = out[k] + g if k in out else g
    return out


def score(net: Network, texts: list[str | None], rows: int = 4096) -> np.ndarray:
    """The score of each text, rounded to 6 places: its highest window's probability."""
    out = []
    for _, encoded in chunks(texts):
        words = Words(encoded, ALNUM)
        v = vocabulary(words)
        at, live, bounds = windows_of(words, v)
        x = net.inputs(v)
        proj = {d: x @ net.p[f"x{d}"] + net.p[f"c{d}"] for d in "fb"}
        z = np.concatenate([net_logits(net, proj, at[i : i + rows], live[i : i + rows]) for i in range(0, len(at), rows)])
        out.append(np.maximum.reduceat(z, bounds[:-1]))
    z = np.concatenate(out) if out else np.zeros(0, f32)
    return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), 6)


def net_logits(net: Network, proj: dict[str, np.ndarray], at: np.ndarray, live: np.ndarray) -> np.ndarray:
    """As ``Network.logits``, with the inputs' products at hand."""
    s = np.concatenate([net._run(proj[d], at, live, d, None) for d in "fb"], axis=2)
    e = np.where(live.T, s @ net.p["a"], f32(-1e9))
    e = np.exp(e - e.max(axis=0)) * live.T
    alpha = e / np.maximum(e.sum(axis=0), f32(1e-9))
    return np.einsum("tb,tbh->bh", alpha, s) @ net.p["w"] + net.p["b"][0]


def held_out(key: object) -> bool:
    return zlib.crc32(str(key).encode()) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most so many toxic and other documents that aren't held out, those of the lowest hashes of doc_id, as far as CHARS characters of each reach."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(positives).union(known.filter("toxic = 0").orderBy(*order).limit(negatives))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # the bounds above
    before = Window.partitionBy("toxic").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chars", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(before)).filter(F.col("chars") <= CHARS)
    found = sorted({(r["doc_id"], r["text"] or "", r["toxic"]) for r in rows.collect()})
    return [r[1] for r in found], np.array([r[2] for r in found], np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs as struct ``row`` with its score.

    Fitted on ``labelled_sample``; without any label, scores are those of a network that wasn't fitted.
    Null texts are scored as empty ones. Equal texts have equal scores, so repeated rows repeat; a text of
    any length is scored whole, by its highest window. An empty table gives no row.
    """
    texts, y = labelled_sample(docs, labels)
    net = train(texts, y) if len(texts) else Network()
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Network.__new__(Network)
        m.p = pickle.loads(held.value)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score(m, part.column(part.num_columns - 1).to_pylist()))], [*part.schema.names[:-1], "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return arrow(rows, run, T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("row.doc_id", "score")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))
    return out.select("doc_id", (F.crc32(key.cast("binary")) % 4 == 2).alias("held_out"), "score", F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"))
