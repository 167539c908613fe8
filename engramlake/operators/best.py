"""What a task keeps of the rows it reads for each query of a batch: the first few of each, and nothing of the others.

Pairs of a row and a query are never made as rows. Terms are found by looking up the windows of a batch's bytes;
a query looks at the rows of its rarer terms alone, once no row of the others can come in.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of lines that are looked into at once, and the hash's factor.
STEP, FACTOR = 4 << 20, np.uint64(0x9E3779B97F4A7C15)


class Terms:
    """The rows of a batch that hold each of these terms, as parts of UTF-8 text."""

    def __init__(self, terms: list[str]) -> None:
        self.words = [t.encode() for t in terms]
        heads: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(self.words):
            heads[min(len(w), 8)][int.from_bytes(w[:8], "little")].append(i)
        self.tables = []
        for n in sorted(heads):
            codes = np.array(sorted(heads[n]), np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(codes * FACTOR) >> np.uint64(48)] = True
            self.tables.append((n, codes, seen, [heads[n][int(c)] for c in codes]))

    def found(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and rows, by term and row, each pair once. starts has the text's end last."""
        m, pairs, code, done = len(starts) - 1, [np.zeros(0, np.int64)], np.zeros(len(text), np.uint64), 0
        for n, codes, seen, members in self.tables:
            while done < n:  # windows of one byte more
                code = code[: len(text) - done]
                code |= text[done:].astype(np.uint64) << np.uint64(8 * done)
                done += 1
            at = np.flatnonzero(seen[(code * FACTOR) >> np.uint64(48)])
            place = np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)
            same = codes[place] == code[at]
            at, place = at[same], place[same]
            row = np.searchsorted(starts, at, "right") - 1
            inside = at + n <= starts[row + 1]
            at, place, row = at[inside], place[inside], row[inside]
            one = np.array([x[0] if len(x) == 1 and len(self.words[x[0]]) <= 8 else -1 for x in members])
            short = one[place] >= 0
            pairs.append(one[place[short]] * m + row[short])
            for p in np.unique(place[~short]):
                for i in members[p]:
                    w, a = self.words[i], at[place == p]
                    a = a[a + len(w) <= starts[np.searchsorted(starts, a, "right")]]
                    for j in range(8, len(w)):
                        a = a[text[a + j] == w[j]]
                    pairs.append(i * m + np.searchsorted(starts, a, "right") - 1)
        return self._split(pairs, m)

    @staticmethod
    def _split(pairs: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(np.concatenate(pairs))
        return both // max(m, 1), both % max(m, 1)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some STEP bytes of its first column."""
    ends = np.frombuffer(b.column(0).buffers()[1], np.int32)[b.column(0).offset :][: b.num_rows + 1].astype(np.int64) if b.num_rows else np.zeros(1, np.int64)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


class Words:
    """For queries of terms, the rows of the highest share of terms x weight x recency; ties go by the columns of order."""

    def __init__(self, queries: list[list[str]], limit: int, order: int) -> None:
        ids: dict[str, int] = {}
        self.queries, self.limit, self.order = [], limit, order
        for q in queries:
            times: dict[int, int] = defaultdict(int)
            for t in q:
                times[ids.setdefault(t, len(ids))] += 1
            self.queries.append((len(q), list(times.items())))
        self.terms, self.n_terms = Terms(list(ids)), len(ids)
        flat = [(q, t, n) for q, (_, times) in enumerate(self.queries) for t, n in times]
        self.flat = tuple(np.array([x[i] for x in flat], np.int64) for i in range(3))
        self.best: list[list[tuple]] = [[] for _ in queries]  # (-score, order, payload), the first ones

    def take(self, b: pa.RecordBatch) -> None:
        """Columns: lower-cased line, weight, recency, those of order, payload."""
        c = b.column(0)
        line = c.fill_null("") if c.null_count else c
        ends = np.frombuffer(line.buffers()[1], np.int32)[line.offset :][: b.num_rows + 1].astype(np.int64)
        if ends[0] == ends[-1] or not self.n_terms:
            return
        text = np.frombuffer(line.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        term, row = self.terms.found(text, ends - ends[0])
        if not len(term):
            return
        cuts = np.searchsorted(term, np.arange(self.n_terms + 1))
        weight, recency = (b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
        keys = [b.column(3 + i).to_pylist() for i in range(self.order)]
        tuples = [tuple((x is not None, x) for x in k) for k in zip(*keys, strict=True)]
        rank = np.empty(b.num_rows, np.int64)
        rank[sorted(range(b.num_rows), key=tuples.__getitem__)] = np.arange(b.num_rows)
        counts, bounds = np.zeros(b.num_rows, np.int64), {}

        def score(h: np.ndarray | int, n: int, rows: np.ndarray | slice) -> np.ndarray:
            s = h / float(n) * weight[rows] * recency[rows]
            return np.where(np.isnan(s), -np.inf, s)

        def beaten(q: int, h: int, n: int) -> bool:
            """No row with up to h of the n terms comes before what the query has."""
            if len(self.best[q]) < self.limit:
                return False
            if (h, n) not in bounds:
                s = np.maximum(score(h, n, slice(None)), score(1, n, slice(None)))
                top = np.flatnonzero(s == s.max())
                bounds[h, n] = (-s.max(), tuples[top[np.argmin(rank[top])]])
            return bounds[h, n] > self.best[q][-1][:2]

        q_of, t_of, n_of = self.flat
        most = np.bincount(q_of, n_of * (cuts[t_of + 1] > cuts[t_of]), len(self.queries)).astype(np.int64)
        for q in np.flatnonzero(most).tolist():
            n, times = self.queries[q]
            if beaten(q, int(most[q]), n):
                continue
            held = sorted(((cuts[t + 1] - cuts[t], t, k) for t, k in times if cuts[t + 1] > cuts[t]), reverse=True)
            h = skip = 0
            while beaten(q, h := h + held[skip][2], n):  # not for all terms, as of ``most``
                skip += 1
            rows = np.unique(np.concatenate([row[cuts[t] : cuts[t + 1]] for _, t, _ in held[skip:]]))
            for _, t, k in held:
                counts[row[cuts[t] : cuts[t + 1]]] += k
            s = score(counts[rows], n, rows)
            counts[:] = 0
            if len(self.best[q]) == self.limit:
                on = s >= -self.best[q][-1][0]
                rows, s = rows[on], s[on]
            if len(rows) > self.limit:
                on = s >= np.partition(s, len(s) - self.limit)[len(s) - self.limit]
                rows, s = rows[on], s[on]
            first = np.lexsort((rank[rows], -s))[: self.limit]
            new = [(-float(s[i]), tuples[rows[i]], None, int(rows[i])) for i in first]
            kept = sorted([*self.best[q], *new], key=lambda x: x[:2])[: self.limit]
            self.best[q] = [x if x[2] is not None else (*x[:2], tuple(b.column(i)[x[3]].as_py() for i in range(3 + self.order, b.num_columns))) for x in kept]

    def rows(self, keys: list[int]) -> Iterator[tuple]:
        """key, score (null: without one), the columns of order and the payload."""
        for key, best in zip(keys, self.best, strict=True):
            for s, order, payload in (x[:3] for x in best):
                yield (key, None if s == np.inf else -s, *(x for _, x in order), *payload)


def words(keys: list[int], queries: list[list[str]], limit: int, order: int):  # noqa: ANN201
    """For ``mapInArrow``; see ``Words``. Gives the columns of its ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, schema = Words(queries, limit, order), None
        for b in batches:
            schema = b.schema
            for part in _slices(b):
                kept.take(part)
        if schema is not None:
            types, out = [pa.int64(), pa.float64(), *schema.types[3:]], list(kept.rows(keys))
            for i in range(0, len(out), 10_000):
                columns = zip(*out[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["key", "unrounded", *schema.names[3:]])

    return run


# --- vectors

#: Queries that meet a batch of vectors at once, and the decimal places of a score.
QUERIES, PLACES = 256, 6


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order: the same bits as ``expr.dot``."""
    s = np.zeros(len(a))
    for d in range(a.shape[1]):
        s += a[:, d] * b[:, d]
    return s


def _score(dot: np.ndarray, norms: np.ndarray, stretch: float) -> np.ndarray:
    """As ``disclosure.nearest`` has it: 0 without a direction, and what isn't a number counts as 1."""
    with np.errstate(all="ignore"):
        c = np.where(norms == 0, 0.0, dot / norms)
        return np.where(np.isnan(c), 1.0, np.minimum(1.0, np.maximum(0.0, c) * stretch))


def _matrix(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which are of this size and without nulls; others are zeros."""
    ok = np.array([v is not None and len(v) == dim and None not in v for v in vectors], bool)
    out = np.zeros((len(vectors), dim))
    if dim and ok.any():
        out[ok] = np.array([v for v, k in zip(vectors, ok, strict=True) if k], np.float64).reshape(-1, dim)
    return out, ok


def _arrow_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten()
    if not column.null_count and not flat.null_count and len(flat) == dim * len(column) and bool((np.diff(column.offsets.to_numpy()) == dim).all()):
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), np.ones(len(column), bool)
    return _matrix(column.to_pylist(), dim)


class Near:
    """For queries, the vectors of the highest rounded score; ties go to the smaller doc_id.

    A product of matrices leaves out what can't be among the first; the scores of the rest are worked out in the
    order of ``expr.dot`` wherever rounding could tell.
    """

    def __init__(self, vectors: list, norms: list, limit: int, stretch: float) -> None:
        self.limit, self.stretch, sizes = limit, stretch, defaultdict(list)
        for i, v in enumerate(vectors):
            sizes[0 if v is None or None in v else len(v)].append(i)
        self.none, self.norms = np.array([n is None for n in norms], bool), np.array([0.0 if n is None else n for n in norms], np.float64)
        self.groups = {dim: (np.array(of), _matrix([vectors[i] for i in of], dim)[0]) for dim, of in sizes.items()}
        self.scores: list[list[float]] = [[] for _ in vectors]
        self.ids: list[list] = [[] for _ in vectors]

    def take(self, ids: list, column: pa.Array, norms: pa.Array, allowed: np.ndarray | None = None, only: np.ndarray | None = None) -> None:
        """Vectors with their ids and norms; allowed: which queries may have which rows; only: the queries to ask."""
        take = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), np.int64)
        ids, none = [ids[i] for i in take], norms.is_null().to_numpy(zero_copy_only=False)[take]
        n = norms.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)[take]
        for dim, (of, q) in self.groups.items():
            rows, ok = _arrow_matrix(column, dim) if dim else (np.zeros((len(ids), 0)), np.zeros(len(ids), bool))
            rows, ok = rows[take], ok[take] & ~none
            chosen = np.arange(len(of)) if only is None else np.flatnonzero(only[of])
            for at in range(0, len(chosen), QUERIES):
                part = chosen[at : at + QUERIES]
                self._block(of[part], q[part], ids, rows, n, ok, None if allowed is None else allowed[of[part]][:, take])

    def _exact(self, rows: np.ndarray, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return _score(_dot(rows, q), norms, self.stretch)

    def _block(self, of: np.ndarray, q: np.ndarray, ids: list, rows: np.ndarray, norms: np.ndarray, ok: np.ndarray, allowed: np.ndarray | None) -> None:
        with np.errstate(all="ignore"):
            both = self.norms[of][:, None] * norms[None, :]
            s = _score(q @ rows.T, both, self.stretch)
            odd = ~((both == 0) | (both > 1e-200) & (both < 1e200))  # sums in another order may differ by much
        known = ok[None, :] & ~self.none[of][:, None]
        s[~known] = 0.0
        i, j = np.nonzero(odd & known)
        for x in range(0, len(i), 1 << 16):
            a, b = i[x : x + (1 << 16)], j[x : x + (1 << 16)]
            s[a, b] = self._exact(rows[b], q[a], both[a, b])
        if allowed is not None:
            s[~allowed] = -1.0
        scale, m = 10.0**PLACES, s.shape[1]
        least = np.array([x[-1] if len(x) == self.limit else -0.5 for x in (self.scores[i] for i in of)])
        if (least < 0).any() and m >= self.limit:
            least = np.maximum(least, np.partition(s, m - self.limit, axis=1)[:, m - self.limit])
        a, r = np.nonzero(s >= np.maximum(least - 2 / scale, -0.5)[:, None])
        found = s[a, r]
        edge = found * scale + 0.5
        edge = np.flatnonzero(np.abs(edge - np.round(edge)) < 1e-4)
        for x in range(0, len(edge), 1 << 16):
            e = edge[x : x + (1 << 16)]
            e = e[known[a[e], r[e]]]
            found[e] = self._exact(rows[r[e]], q[a[e]], both[a[e], r[e]])
        found = np.floor(found * scale + 0.5) / scale
        by = np.lexsort((r, -found, a))  # rows are in order of id
        a, r, found = a[by], r[by], found[by]
        first = np.arange(len(a)) - np.searchsorted(a, a) < self.limit
        a, r, found = a[first], r[first], found[first]
        cuts = np.searchsorted(a, np.arange(len(of) + 1))
        key = lambda x: (-x[0], x[1] is not None, x[1])
        for x in np.unique(a).tolist():
            i, new = int(of[x]), slice(cuts[x], cuts[x + 1])
            kept = sorted([*zip(self.scores[i], self.ids[i], strict=True), *zip(found[new].tolist(), (ids[y] for y in r[new].tolist()), strict=True)], key=key)[: self.limit]
            self.scores[i], self.ids[i] = [v for v, _ in kept], [d for _, d in kept]

    def rows(self, keys: list) -> Iterator[tuple]:
        for key, scores, ids in zip(keys, self.scores, self.ids, strict=True):
            yield from ((key, d, v) for v, d in zip(scores, ids, strict=True))


def near(keys: list[int], queries: list[tuple], limit: int, stretch: float, cells: dict[int, np.ndarray] | None = None):  # noqa: ANN201
    """For ``mapInArrow`` over doc_id, embedding, norm and, with directories, hierarchy_path and, with cells, cell; gives query (its key), doc_id and score.

    queries: embedding, norm and directory (null: all); cells: of each cell which queries read it.
    """
    directories = sorted({q[2] for q in queries} - {None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kind = Near([q[0] for q in queries], [q[1] for q in queries], limit, stretch), None
        asks = {d: np.array([q[2] == d for q in queries], bool) for d in directories}
        for b in batches:
            kind, at = b.schema.field(0).type, {n: i for i, n in enumerate(b.schema.names)}
            groups = [(None, None)]
            if cells is not None:
                cell = b.column(at["cell"]).to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero(cell == c), cells[c]) for c in np.unique(cell).tolist() if c in cells]
            for rows, only in groups:
                p = b if rows is None else b.take(pa.array(rows))
                allowed = None
                if directories:
                    paths = p.column(at["hierarchy_path"]).to_pylist()
                    allowed = np.ones((len(queries), p.num_rows), bool)
                    for d, asked in asks.items():
                        allowed[asked] = np.array([x is not None and x.startswith(d) for x in paths], bool)
                kept.take(p.column(0).to_pylist(), p.column(1), p.column(2), allowed, only)
        out = list(kept.rows(keys))
        for i in range(0, len(out), 10_000):
            k, d, s = zip(*out[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, kind), pa.array(s, pa.float64())], ["query", "doc_id", "score"])

    return run
