"""Clusters of sets linked by Jaccard similarity, by a prefix-tree join.

Sets are of 64-bit n-gram numbers in one global order. Keys say which sets may be linked: all sets
with a key form a group under one of them, the hub, and a pair meets wherever it shares a hub. Sizes
and parity signatures, which bound how much two sets differ, take out members that can't be linked
with any other of the group. The rest go, hub by hub and in blocks of at most BLOCK sets, each to
one task that stores its sets in a trie and traverses it with each set in turn: overlaps of shared
prefixes are counted once, and subtrees whose remaining length can't reach the needed overlap, or
that are in the set's component already, are pruned. What lies outside the largest cluster of a
group of several blocks then meets all sets of the group, block by block. So no link is lost, and
no group of any size meets in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, connected_components, written
from .textnum import U, mix

#: Sets and tokens of a block, keys of a bucket, and keys that are packed at a time.
BLOCK, TOKENS, BUCKET, PACK = 2048, 1 << 21, 1 << 18, 1 << 19


class _Node:
    __slots__ = ("edge", "ends", "high", "kids", "low", "mixed", "one")

    def __init__(self, edge: list[int], low: int, high: int, one: int, mixed: bool = False) -> None:
        self.edge, self.kids, self.ends, self.low, self.high, self.one, self.mixed = edge, {}, [], low, high, one, mixed


class PrefixTree:
    """Joins sets given in ascending size: ``add`` links each with the similar ones so far, ``label`` gives the smallest number of its component."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.root, self.up = num, den, _Node([], 1 << 60, 0, -1), []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, tokens: list[int], known: int | None = None) -> None:
        """tokens: a set in ascending order, at least as large as those before; an empty set is linked with nothing.

        known: a set's number that this one is known to be in a component with.
        """
        i = len(self.up)
        self.up.append(i if known is None else self.find(known))
        if tokens:
            self._link(i, tokens)
            self._store(i, tokens)

    def label(self, i: int) -> int:
        return self.find(i)

    def _link(self, i: int, x: list[int]) -> None:
        num, den, both, n, held = self.num, self.den, self.num + self.den, len(x), set(x)
        least = -(-num * n // den)  # of a linked set's size
        stack = [(self.root, 0, 0, n)] if self.root.kids else []
        while stack:
            node, depth, shared, left = stack.pop()
            if node.high < least or not node.mixed and node.one >= 0 and self.find(node.one) == self.find(i):
                continue
            need = -(-num * (n + max(node.low, least)) // both)
            if shared + min(left, node.high - depth) < need:
                continue
            if node.edge:
                shared += len(held.intersection(node.edge))
                depth += len(node.edge)
                left = n - bisect_right(x, node.edge[-1])
                if shared + min(left, node.high - depth) < need:
                    continue
            if node.ends and shared * both >= num * (n + depth):
                for e in node.ends:
                    a, b = self.find(e), self.find(i)
                    self.up[max(a, b)] = min(a, b)
            later = []
            for t, kid in node.kids.items():
                (later if t in held else stack).append((kid, depth, shared, left))
            stack += later

    def _store(self, i: int, x: list[int]) -> None:
        n, node, at = len(x), self.root, 0
        while True:
            if node.one >= 0 and not node.mixed and self.find(node.one) != self.find(i):
                node.mixed = True
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node.one < 0:
                node.one = i
            if at == n:
                node.ends.append(i)
                return
            kid = node.kids.get(x[at])
            if kid is None:
                kid = node.kids[x[at]] = _Node(x[at:], n, n, i)
                kid.ends.append(i)
                return
            edge, k = kid.edge, 1
            while k < len(edge) and at + k < n and edge[k] == x[at + k]:
                k += 1
            if k < len(edge):  # the edge parts here
                upper = _Node(edge[:k], kid.low, kid.high, kid.one, kid.mixed)
                kid.edge = edge[k:]
                upper.kids[kid.edge[0]] = kid
                node.kids[x[at]] = kid = upper
            node, at = kid, at + k


def _joined(placed: DataFrame, num: int, den: int) -> DataFrame:
    """node, component, blocks and label (smallest node of its local cluster) of sets placed in (component, block).

    Sets of equal ``known``, where it isn't null, are in one component from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, nodes, groups, tree, blocks = None, [], {}, None, 1
        done: list[tuple[int, int, int, int]] = []

        def close() -> None:
            least: dict[int, int] = {}
            for i, v in enumerate(nodes):
                least[tree.label(i)] = min(v, least.get(tree.label(i), v))
            done.extend((v, here[0], blocks, least[tree.label(i)]) for v, i in dict(zip(nodes, range(len(nodes)), strict=True)).items())

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(4)], ["node", "component", "blocks", "label"])
            done.clear()
            return out

        for b in batches:
            component, block, count, node, known = (b.column(k).to_pylist() for k in range(5))
            lists = b.column(6)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, at in enumerate(zip(component, block, strict=True)):
                if at != here:
                    if nodes:
                        close()
                    here, nodes, groups, tree, blocks = at, [], {}, PrefixTree(num, den), count[k]
                group = None if known[k] is None else groups.setdefault(known[k], len(nodes))
                tree.add(flat[ends[k] : ends[k + 1]].tolist(), None if group in (None, len(nodes)) else group)
                nodes.append(node[k])
            if len(done) > 50_000:
                yield batch()
        if nodes:
            close()
        yield batch()

    dealt = placed.select("component", "block", "blocks", "node", "known", F.size("tokens").alias("n"), "tokens").repartition("component", "block").sortWithinPartitions("component", "block", "n", "node")
    return arrow(dealt, run, "node long, component long, blocks long, label long")


def pack(keys: np.ndarray, nodes: np.ndarray, bits: int, place: int, alone: bool = False) -> pa.RecordBatch:
    """Postings (key, node) as PACKED: arrays by bucket, the first bits of a key's hash."""
    bucket = (mix(keys.view(U)) >> U(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, start = np.unique(bucket[order], return_index=True)
    cuts = [*start.tolist(), len(keys)]
    of = lambda x: [x[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = ([alone] * len(there), there.tolist(), [place] * len(there), of(keys), of(nodes))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["alone", "bucket", "place", "keys", "nodes"])


def bucket_bits(total: int) -> int:
    """How many bits of a hash give buckets of about BUCKET of so many postings."""
    return max(6, (total // BUCKET).bit_length())


#: Of ``alone`` postings only the keys that several nodes have are wanted.
PACKED = "alone boolean, bucket long, place long, keys binary, nodes binary"


def packed(nodes: DataFrame) -> DataFrame:
    """The postings of ``node`` and ``keys`` (longs) as PACKED: 16 bytes each."""
    bits = bucket_bits(nodes.agg(F.sum(F.size("keys"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, many = TaskContext.get().partitionId() << 32, [], 0

        def rows() -> pa.RecordBatch:
            nonlocal place, held, many
            keys, node = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
            held, many, place = [], 0, place + 1
            return pack(keys, node, bits, place)

        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            held.append((lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64), np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(ends))))
            many += len(held[-1][0])
            if many >= PACK:
                yield rows()
        yield rows()

    return arrow(nodes.select("node", "keys"), run, PACKED)


def shared_keys(postings: DataFrame) -> DataFrame:
    """hub and node, distinct: every node that shares a key with others, under the first of them; of ``alone`` postings key and null.

    A bucket's task streams its postings (PACKED): it holds one node for each key, whatever the number of a key's nodes.
    """

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, heads, wait, many = (False, -1), np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def meet() -> pa.RecordBatch:
            """Pairs of the waiting postings with the first node of their key, which is held from here on."""
            nonlocal keys, heads, wait, many
            k, v = (np.concatenate([w[i] for w in wait]) for i in (0, 1))
            wait, many = [], 0
            every, first, back = np.unique(k, return_index=True, return_inverse=True)
            head = v[first]
            at = np.minimum(np.searchsorted(keys, every), max(len(keys) - 1, 0))
            known = keys[at] == every if len(keys) else np.zeros(len(every), bool)
            head[known] = heads[at[known]]
            other = head[back] != v
            pairs = np.unique(k[other])[:, None] if here[0] else np.unique(np.stack([head[back], v], axis=1)[other], axis=0)
            keys, heads = np.concatenate([keys, every[~known]]), np.concatenate([heads, head[~known]])
            order = np.argsort(keys, kind="stable")
            keys, heads = keys[order], heads[order]
            columns = [pa.array(np.ascontiguousarray(c)) for c in pairs.T]
            return pa.RecordBatch.from_arrays(columns if len(columns) > 1 else [*columns, pa.nulls(len(pairs), pa.int64())], ["hub", "node"])

        for b in batches:
            for alone, bucket, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                if (alone, bucket) != here:
                    if wait:
                        yield meet()
                    here, keys, heads = (alone, bucket), np.zeros(0, np.int64), np.zeros(0, np.int64)
                wait.append((np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), np.int64)))
                many += len(wait[-1][0])
                if many >= PACK:
                    yield meet()
        if wait:
            yield meet()

    return arrow(postings.repartition("alone", "bucket").sortWithinPartitions("alone", "bucket", "place"), star, "hub long, node long").distinct()


def signature_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the signature of sets of these sizes: the power of two from 256 on that is n at least."""
    return 1 << np.maximum(8, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set ``tokens[bounds[i]:bounds[i + 1]]`` the parity of its tokens' counts by hash: two differ in at most as many bits as the sets in tokens."""
    n = np.diff(bounds)
    size = signature_bits(n)
    base = np.concatenate([[0], np.cumsum(size)])
    bit = np.repeat(base[:-1], n) + (mix(tokens.view(U)) & np.repeat(size - 1, n).astype(U)).astype(np.int64)
    odd = np.packbits((np.bincount(bit, minlength=int(base[-1])) & 1).astype(bool)).tobytes()
    return [odd[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def may_link(n: np.ndarray, sigs: list[bytes], num: int, den: int) -> np.ndarray:
    """Which of some sets (in ascending size) may be linked with another of them, by size and signature; exact in that none that is linked is missing."""
    out = np.zeros(len(n), bool)
    wide = {}
    for w in sorted({len(s) for s in sigs}):
        at = np.flatnonzero([len(s) == w for s in sigs])
        wide[w] = at, np.frombuffer(b"".join(sigs[i] for i in at), np.uint8).reshape(len(at), w)
    for w, (at, own) in wide.items():
        for v, (to, other) in wide.items():
            if v < w:
                continue
            folded = other
            while folded.shape[1] > w:  # equal places of the halves: the low bits of a hash pick the place
                half = folded.shape[1] // 2
                folded = folded[:, :half] ^ folded[:, half:]
            a, b = np.ascontiguousarray(own).view(U), np.ascontiguousarray(folded).view(U)
            for i, row in zip(at.tolist(), a, strict=True):
                low, high = np.searchsorted(to, i, "right"), np.searchsorted(n[to], n[i] * den // num, "right")
                if low < high:
                    apart = np.bitwise_count(b[low:high] ^ row).sum(axis=1)
                    near = np.flatnonzero(apart * (den + num) <= (n[i] + n[to[low:high]]) * (den - num))
                    if len(near):
                        out[i] = out[to[low:high][near]] = True
    return out


def _near(members: DataFrame, num: int, den: int) -> DataFrame:
    """hub and node of members (hub, node, n, sig) that may be linked with another of their group; groups are whole and of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group, out = None, [], []

        def close() -> None:
            if len(group) > 1:
                keep = may_link(np.array([g[1] for g in group]), [g[2] for g in group], num, den)
                out.extend((here, g[0]) for g, k in zip(group, keep.tolist(), strict=True) if k)

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], ["hub", "node"])
            out.clear()
            return done

        for b in batches:
            for hub, *member in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if hub != here:
                    close()
                    here, group = hub, []
                group.append(member)
            if len(out) > 50_000:
                yield batch()
        close()
        yield batch()

    return arrow(members.select("hub", "node", "n", "sig").repartition("hub").sortWithinPartitions("hub", "n", "node"), run, "hub long, node long")


def cluster(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, block: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """node and label (smallest node of its cluster) of all nodes that are linked with another.

    pairs: ``hub`` and ``node``, as of ``shared_keys``, of two sets that are linked at least. sets_of(nodes):
    ``name``, ``node`` and ``tokens`` (distinct, ascending) of these nodes' sets; names, by which the
    result calls sets, may tell apart what a node's number doesn't. sizes: ``node``, ``n`` and ``sig``
    (``signatures``), if members are to be chosen by them first. Links are sets with
    |intersection| * den >= num * |union|.
    """
    # as many blocks as keep sets and tokens of one within bounds
    parts = lambda sets, tokens: F.ceil(F.greatest(sets / block, tokens / TOKENS))
    members = pairs.union(pairs.select("hub", F.col("hub").alias("node")).distinct())
    if sizes is not None:
        members = written(members.join(sizes, "node").select("hub", "node", "n", "sig"))
        hubs = members.groupBy("hub").agg(parts(F.count("*"), F.sum("n")).alias("blocks"))
        few = _near(members.join(hubs.filter("blocks = 1").select("hub"), "hub"), num, den).withColumn("blocks", F.lit(1).cast("long"))
        members = few.union(members.join(hubs.filter("blocks > 1"), "hub").select("hub", "node", "blocks"))
    else:
        members = members.join(members.groupBy("hub").agg(F.ceil(F.count("*") / block).alias("blocks")), "hub").select("hub", "node", "blocks")
    members = written(members)
    sets = written(sets_of(members.select("node").distinct()))
    chosen = members.join(sets, "node").select("hub", F.col("name").alias("node"), "tokens", "blocks")
    sets = sets.select(F.col("name").alias("node"), "tokens")
    deal = lambda rows, turn: rows.select(F.col("hub").alias("component"), "node", "tokens", "blocks", F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("blocks")).alias("block"), F.lit(None).cast("long").alias("known"))
    local = written(_joined(deal(chosen, 0), num, den))
    links = local.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    split = local.filter("blocks > 1").select(F.col("component").alias("hub"), "node", "label", "blocks")
    n = split.count()
    if not n:
        return connected_components(links).withColumnRenamed("component", "label")
    # groups of several blocks: one set for each local cluster, dealt anew while that at least halves them
    for turn in range(1, 40):
        heads = split.select("hub", F.col("label").alias("node")).distinct()
        left = heads.count()
        if left > n // 2:
            break
        dealt = heads.join(sets, "node")
        blocks = dealt.groupBy("hub").agg(parts(F.count("*"), F.sum(F.size("tokens"))).alias("blocks"))
        level = written(_joined(deal(dealt.join(blocks, "hub"), turn), num, den).select(F.col("component").alias("hub"), F.col("node").alias("label"), F.col("label").alias("higher")))
        links = links.union(level.filter("label <> higher").select("label", "higher"))
        split, n = written(split.join(level, ["hub", "label"]).select("hub", "node", F.col("higher").alias("label"), "blocks")), left
    # sets outside their group's largest cluster then meet all others, a block of these with a block of all in a task
    size = split.join(sets.select("node", F.size("tokens").alias("n")), "node").groupBy("hub", "label").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    most = size.groupBy("hub").agg(F.max_by("label", "c").alias("most"), F.sum("c").alias("c"), F.sum("t").alias("t"), F.max("c").alias("mc"), F.max_by("t", "c").alias("mt"))
    most = most.filter("c > mc").select("hub", "most", parts(F.col("c"), F.col("t")).alias("columns"), parts(F.col("c") - F.col("mc"), F.col("t") - F.col("mt")).alias("rows"))
    part = sets.join(split.select("hub", "node", F.col("label").alias("known")), "node").join(most, "hub")
    spot = lambda count: F.pmod(F.xxhash64(F.lit(77), "node"), F.col(count))
    across = part.select("hub", "node", "tokens", "known", "columns", spot("columns").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
    down = part.filter("known <> most").select("hub", "node", "tokens", "known", "columns", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), spot("rows").alias("i"))
    met = across.union(down.select("hub", "node", "tokens", "known", "columns", "j", "i")).select(F.col("hub").alias("component"), "node", "tokens", "known", F.lit(2).cast("long").alias("blocks"), (F.col("i") * F.col("columns") + F.col("j")).cast("long").alias("block"))
    found = _joined(met, num, den).filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return connected_components(links.union(written(found))).withColumnRenamed("component", "label")
