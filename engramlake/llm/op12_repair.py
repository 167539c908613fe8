"""Conversation repair: an error-correcting Earley parser over a weighted grammar of roles.

A dialogue is nothing, or user and assistant in turn with a system message in front or not. Rows that
don't fit are deleted, given another role, or joined by inserted ones; each edit has a cost. Chart
items keep the least (cost, audit), the audit being the edits' initials, and the completed chart
gives the repair. The grammar is left-linear, so every item begins where the chart does and a column
holds a bounded number of them.

A conversation may hold any share of all rows, so charts cover stretches of it: what a stretch costs
from each state of the grammar to each other, and the order of the audits, is all that others need.
Stretches meet in a tree, the states chosen go down again, and only then are edits spelled out. Two
audits of the same rows that end with a row's edit never are the beginning of one another, so their
order holds whatever follows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, table, written

#: What each symbol is made of. A rule's last symbol is a message's role or a deletion, which the edits give.
GRAMMAR = {
    "none": (("none", "delete"),),
    "system": (("none", "s"), ("system", "delete")),
    "asked": (("none", "u"), ("system", "u"), ("done", "u"), ("asked", "delete")),
    "done": (("asked", "a"), ("done", "delete")),
    "dialogue": (("none",), ("done",)),
}
STATES = ("none", "system", "asked", "done")
REROLE, DELETE, INSERT, OPEN = 3, 4, 3, 3
#: What must be inserted at the end, by the state after the last row.
TAILS = {"none": "", "system": "II", "asked": "I", "done": ""}
#: The logarithm of the rows of a stretch and of the stretches that meet at once.
BITS = 10
ROLES = {"u": "user", "a": "assistant"}
#: Rows as symbols: initials s, u, a and x (any other); in upper case if the text breaks off, as digits if the row must go.
FINE, BROKEN, GONE = "suax", "SUAX", "0123"


def edits(terminal: str, symbol: str) -> list[tuple[str, int]]:
    """The edits by which a row can be a terminal of the grammar, with their costs."""
    if terminal == "delete":
        return [("D", DELETE)]
    if symbol in GONE:
        return []
    more = OPEN if symbol in BROKEN else 0
    keep = [("K", more)] if symbol.lower() == terminal else []
    return keep + ([("R", REROLE + more)] if terminal in ROLES else [])


def parse(word: str, start: str = "none") -> tuple[dict[str, tuple[int, str]], tuple[int, str]]:
    """The least (cost, audit) of rows as symbols, from a state of the grammar: by state right after the last row, and of the whole dialogue.

    Items are (symbol, rule, dot, origin); the state that a chart starts from is the one with an empty rule.
    """
    columns: list[dict[str, list]] = []  # by column: the items that wait for a symbol
    heap = [(0, "", (s, rule, 0, 0)) for s in GRAMMAR for rule in GRAMMAR[s]] + [(0, "", (start, (), 0, 0))]
    ends: dict[str, tuple[int, str]] = {}
    best = 0, ""
    for j in range(len(word) + 1):
        if j == len(word):
            for cost, audit, (s, _, _, _) in heap:  # nothing is inserted yet
                if j:
                    ends[s] = min(ends.get(s, (cost, audit)), (cost, audit))
        heapq.heapify(heap)
        waits: dict[str, list] = defaultdict(list)
        columns.append(waits)
        seen, done, onward = set(), {}, []
        while heap:
            cost, audit, item = heapq.heappop(heap)  # least first: an item's first value is its best
            s, rule, dot, origin = item
            if item in seen or (dot == len(rule) and (s, origin) in done):
                continue
            seen.add(item)
            if dot == len(rule):  # complete: what waited for it at its origin goes on
                done[s, origin] = cost, audit
                for c, a, (s2, r2, d2, o2) in columns[origin][s]:
                    heapq.heappush(heap, (c + cost, a + audit, (s2, r2, d2 + 1, o2)))
                continue
            wanted = rule[dot]
            waits[wanted].append((cost, audit, item))
            if wanted in GRAMMAR:  # its rules are predicted at the start already
                if (wanted, j) in done:
                    c, a = done[wanted, j]
                    heapq.heappush(heap, (cost + c, audit + a, (s, rule, dot + 1, origin)))
                continue
            if wanted in ROLES:
                heapq.heappush(heap, (cost + INSERT, audit + "I", (s, rule, dot + 1, origin)))
            if j < len(word):
                onward.extend((cost + c, audit + e, (s, rule, dot + 1, origin)) for e, c in edits(wanted, word[j]))
        best = done.get(("dialogue", 0), best)
        heap = onward
        if 0 < j:
            columns[j] = defaultdict(list)  # no item begins here
    return ends, best


_short = lru_cache(maxsize=50_000)(parse)


def parsed(word: str, start: str = "none") -> tuple[dict[str, tuple[int, str]], tuple[int, str]]:
    """``parse``, remembered for short conversations, which are often alike."""
    return _short(word, start) if len(word) <= 64 else parse(word, start)


def summary(word: str) -> tuple[list[int], list[int]]:
    """By state before and after (4 x 4): the least cost of a stretch (-1: none), and the order of its audit among those from the same state."""
    costs, ranks = [], []
    for p in STATES:
        ends = parsed(word, p)[0]
        order = {r: i for i, (_, r) in enumerate(sorted((a, r) for r, (_, a) in ends.items()))}
        costs.extend(ends[r][0] if r in ends else -1 for r in STATES)
        ranks.extend(order.get(r, -1) for r in STATES)
    return costs, ranks


def _onward(now: dict[int, tuple[int, int]], costs: list[int], ranks: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """After one more stretch, by state: (cost, order before, order within, state before) of the best."""
    out = {}
    for r, (cost, rank) in now.items():
        for q in range(4):
            if (c := costs[4 * r + q]) >= 0:
                got = cost + c, rank, ranks[4 * r + q], r
                out[q] = min(out.get(q, got), got)
    return out


def _ranked(found: dict[int, tuple[int, int, int, int]]) -> dict[int, tuple[int, int]]:
    order = {x: i for i, x in enumerate(sorted({(v[1], v[2]) for v in found.values()}))}
    return {q: (v[0], order[v[1], v[2]]) for q, v in found.items()}


def compose(stretches: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The summary of stretches in turn."""
    costs, ranks = [-1] * 16, [-1] * 16
    for p in range(4):
        now = {p: (0, 0)}
        for c, r in stretches:
            now = _ranked(_onward(now, c, r))
        for q, (cost, rank) in now.items():
            costs[4 * p + q], ranks[4 * p + q] = cost, rank
    return costs, ranks


def trace(stretches: list[tuple[list[int], list[int]]], p: int, q: int) -> list[tuple[int, int]]:
    """The states before and after each of the stretches on the best way from p to q."""
    now, back = {p: (0, 0)}, []
    for c, r in stretches:
        found = _onward(now, c, r)
        back.append({s: v[3] for s, v in found.items()})
        now = _ranked(found)
    out = []
    for b in reversed(back):
        out.append((b[q], q))
        q = b[q]
    return out[::-1]


def last_state(costs: list[int], ranks: list[int]) -> int:
    """The state after the last row from which the dialogue ends best."""
    return min((costs[q] + INSERT * len(TAILS[STATES[q]]), ranks[q], q) for q in range(4) if costs[q] >= 0)[2]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage: by a checksum of conversation and turn a row goes, loses its text or its stops, comes twice, or is the user's. Nulls count as one space."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn"))) % 20
    out = rows.select("conv_id", "turn", s("role").alias("role"), s("text").alias("text"), k.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; nulls as one space) with ``at``, a number in order of conversation, turn (nulls first) and, among equal turns, role and a hash of the text; initial, blank, broken, and hashes h1 and h2 of conversation, role and text.

    Range-partitioned: a conversation, a turn or equal rows of any number lie over several partitions.
    """
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select("conv_id", "turn", s("role").alias("role"), s("text").alias("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    place = F.when(F.left("role", F.lit(1)).isin(*"sua"), F.left("role", F.lit(1))).otherwise("x")
    whole = [F.col("conv_id").isNull(), F.col("conv_id"), F.col("role"), F.col("text")]
    out = out.select("*", place.alias("initial"), F.xxhash64(*whole).alias("h1"), F.xxhash64(F.lit(12), *whole).alias("h2"), F.inline(F.array(F.struct(last.alias("last")))))
    out = out.select("conv_id", "turn", "role", "text", "initial", "h1", "h2", (F.col("last") == "").alias("blank"), (~F.col("last").isin("", ".", "!", "?")).alias("broken"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    keys = ["conv_id", "turn", "role", "h1", "salt"]
    return written(out.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id()))


def _flat(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``at`` in as few bits as their partitions need, and how many bits those are."""
    top = rows.agg(F.max(F.col("at").bitwiseAND(2**33 - 1)).alias("row"), F.max(F.shiftright("at", 33)).alias("part")).first()
    inner = (top["row"] or 0).bit_length()
    at = F.shiftleft(F.shiftright("at", 33), inner) + F.col("at").bitwiseAND(2**33 - 1)
    return rows.withColumn("at", at), inner + (top["part"] or 0).bit_length()


def faults(rows: DataFrame, bits: int) -> DataFrame:
    """conv_id, at and ``code`` of each row: its initial, and whether it must go (blank: b, seen before in the conversation: d) or breaks off (t).

    Equal rows are counted by stretch first, so that any number of them is spread.
    """
    part = F.shiftright("at", bits).alias("part")
    here = rows.filter("NOT blank").groupBy("h1", "h2", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    every = here.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    again = here.drop("first", "n").join(every, ["h1", "h2"])
    out = rows.select("conv_id", "at", "initial", "blank", "broken", "h1", "h2", part).join(again, ["h1", "h2", "part"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("broken"), "t").otherwise("")
    return out.select("conv_id", "at", F.concat("initial", fault).alias("code"))


def _symbol(code: Column) -> Column:
    where = F.instr(F.lit(FINE), F.left(code, F.lit(1)))
    fault = F.substring(code, 2, 1)
    return F.substr(F.when(fault.isin("b", "d"), F.lit(GONE)).when(fault == "t", F.lit(BROKEN)).otherwise(F.lit(FINE)), where, F.lit(1))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a joined with b's other columns by conv_id, null too, and keys."""
    other = b.select(F.col("conv_id").alias("_c"), *(F.col(k).alias(f"_{k}") for k in keys), *(c for c in b.columns if c not in ("conv_id", *keys)))
    on = F.col("conv_id").eqNullSafe(F.col("_c"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(other, on).drop("_c", *(f"_{k}" for k in keys))


def audits(codes: DataFrame, total_bits: int, bits: int = BITS) -> DataFrame:
    """conv_id, at (a stretch's first) and audit: the edits of each stretch of a conversation on the cheapest way through all of them."""
    rows = codes.select("conv_id", "at", _symbol(F.col("code")).alias("symbol"))
    words = rows.groupBy("conv_id", F.shiftright("at", bits).alias("node")).agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("word"))
    words = written(words)
    many = written(words.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id"))
    alone = words.groupBy("conv_id").agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("word").alias("word")).filter("n = 1").select("conv_id", "at", "word")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([parsed(w)[1][1] for w in b.column(2).to_pylist()], pa.string())], ["conv_id", "at", "audit"])

    kind = codes.schema["conv_id"].dataType.simpleString()
    out = arrow(alone, whole, f"conv_id {kind}, at long, audit string")
    levels = -(-max(0, total_bits - bits) // bits)
    if not levels or many.isEmpty():
        return out

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [summary(w) for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["conv_id", "node", "costs", "ranks"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [compose([(x["costs"], x["ranks"]) for x in parts]) for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["conv_id", "node", "costs", "ranks"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(c, x["node"], p, q) for c, parts, first, last in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for x, (p, q) in zip(parts, trace([(x["costs"], x["ranks"]) for x in parts], first, last), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32()))], ["conv_id", "node", "p", "q"])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = [last_state(c, r) for c, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([0] * len(last), pa.int32()), pa.array(last, pa.int32())], ["conv_id", "node", "p", "q"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parsed(w, STATES[p])[0][STATES[q]][1] + (TAILS[STATES[q]] if end else "") for w, p, q, end in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], ["conv_id", "at", "audit"])

    node = f"conv_id {kind}, node long, costs array<long>, ranks array<int>"
    state = f"conv_id {kind}, node long, p int, q int"
    words = written(_same(words, many))
    tree = [written(arrow(words.select("conv_id", "node", "word"), summed, node))]
    groups = []
    for _ in range(levels):
        parts = F.array_sort(F.collect_list(F.struct("node", "costs", "ranks"))).alias("parts")
        groups.append(tree[-1].groupBy("conv_id", F.shiftright("node", bits).alias("up")).agg(parts).withColumnRenamed("up", "node"))
        tree.append(written(arrow(groups[-1], met, node)))
    chosen = arrow(tree[-1], ended, state)
    for g in reversed(groups):
        chosen = written(arrow(_same(g, chosen, "node").select("conv_id", "parts", "p", "q"), down, state))
    ends = words.groupBy("conv_id").agg(F.max("node").alias("end"))
    rows = _same(_same(words, chosen, "node"), ends)
    return out.unionByName(arrow(rows.select("conv_id", "at", "word", "p", "q", (F.col("node") == F.col("end")).alias("end")), spelled, f"conv_id {kind}, at long, audit string"))


def repaired(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The edits of each conversation of rows (conv_id, turn, role, text), in order: conv_id, edit (K, R, D, I), fault (blank, duplicate, truncated or null), turn, was (the row's role; null if inserted), role and text. Without those with D they are the repaired conversations.

    Nulls of role and text count as one space, a null conv_id is a conversation like others, turns of
    null come first and equal turns go by role and a hash of the text; so repeated rows lie side by side,
    and all but the first are duplicates. Conversations without rows aren't here. A conversation of any
    length is parsed by stretches of 2^bits rows; its edits then come from one task in order, one row at a
    time. Other columns aren't looked at.
    """
    kept = ordered(rows)
    flat, total = _flat(kept)
    codes = written(faults(flat, bits))
    plan = audits(codes, total, bits)
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    text = flat.select("conv_id", "at", "turn", "role", "text", F.lit(1).alias("part")).unionByName(plan.select("conv_id", "at", F.lit(0).alias("part"), F.col("audit").alias("text")), allowMissingColumns=True)
    text = text.unionByName(codes.select("conv_id", "at", F.lit(0).alias("part"), F.col("code").alias("role")), allowMissingColumns=True)
    text = text.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part", F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, waiting, code = object(), "none", [], ""
        for b in batches:
            out: list[tuple] = []

            def insert(out: list = out) -> None:
                nonlocal state
                r = "a" if state == "asked" else "u"
                out.append((conv, "I", None, None, None, ROLES[r], ""))
                state = "done" if r == "a" else "asked"

            for c, _, t, role, body, part in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if c != conv:
                    conv, state, waiting = c, "none", []
                if part == 0:
                    if body is None:
                        code = role
                    else:
                        waiting = [*body][::-1]
                    continue
                while waiting[-1] == "I":
                    waiting.pop()
                    insert()
                edit, new = waiting.pop(), role
                if edit != "D":
                    r = code[0] if edit == "K" else "a" if state == "asked" else "u"
                    new = role if edit == "K" else ROLES[r]
                    state = {"s": "system", "u": "asked", "a": "done"}[r]
                out.append((conv, edit, {"b": "blank", "d": "duplicate", "t": "truncated"}.get(code[1:]), t, role, new, body))
                while waiting and all(x == "I" for x in waiting):
                    waiting.pop()
                    insert()
            types = (b.schema.field(0).type, pa.string(), pa.string(), b.schema.field(2).type, pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(types)], ["conv_id", "edit", "fault", "turn", "was", "role", "text"])

    return arrow(text.select("conv_id", "at", "turn", "role", "text", "part"), run, f"conv_id {kind}, edit string, fault string, turn {turn}, was string, role string, text string")


class _Digest:
    """What the edits of one conversation come to, as they pass."""

    def __init__(self, conv: object) -> None:
        self.conv, self.counts, self.illegal, self.cost, self.audit = conv, defaultdict(int), 0, 0, []
        self.last, self.turns, self.first_turn, self.turn, self.hash, self.lines = None, 0, None, None, hashlib.sha256(), 0

    def add(self, edit: str, fault: str | None, turn: int | None, was: str | None, role: str, text: str) -> None:
        self.audit.append(edit)
        self.counts[fault] += 1
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (OPEN if fault == "truncated" and edit != "D" else 0)
        if was is not None:
            self.illegal += self.last is not None and self.last + was[:1] not in ("su", "ua", "au")
            self.last = was[:1]
            if turn is not None and turn != self.turn:  # in order
                self.first_turn = turn if self.turn is None else self.first_turn
                self.turn, self.turns = turn, self.turns + 1
        if edit != "D":
            self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digests(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repaired``'s result, taken as it comes: texts are hashed as they pass, and only the audit grows with a conversation."""
    kind = edits.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def batch(rows: list[tuple], first: pa.DataType) -> pa.RecordBatch:
            types = [first, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", *_COLUMNS])

        for b in batches:
            out, first = [], b.schema.field(0).type
            for conv, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now.conv:
                    out += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(*rest)
            if out:
                yield batch(out, first)
        if now:
            yield batch([now.row()], first)

    return arrow(edits, run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = digests(repaired(damaged(rows))).select(F.col("conv_id").alias("found"), *_COLUMNS)
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.select("conv_id", *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in _COLUMNS))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({k}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: From state 0 to 3 (nothing, system, asked, done) by a row's role, with the insertions before it.
_MOVES = ", ".join(
    f"({p}, {q}, '{role}', '{'I' * n}', {INSERT * n})"
    for p, q, role, n in [(0, 1, "s", 0), (0, 2, "u", 0), (0, 3, "a", 1), (1, 2, "u", 0), (1, 3, "a", 1), (2, 3, "a", 0), (2, 2, "u", 1), (3, 2, "u", 0), (3, 3, "a", 1)]
)
#: The same repairs by another route: a step for each row over four states, with whole audits compared.
SQL = {
    "op12_conversation_repair": f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format(k="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}, 4294967295) % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS n FROM k WHERE k <> 0
), o AS (
  SELECT coalesce(conv_id, -1) AS c, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, {_BLANK}) AS t FROM d
), f AS (
  SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), moves(p, q, need, ins, extra) AS (VALUES {_MOVES}), edits AS (
  SELECT p, q, need, ins || 'K' AS e, extra AS cost FROM moves UNION ALL SELECT p, q, '*', ins || 'R', extra + {REROLE} FROM moves WHERE need <> 's' UNION ALL SELECT p, p, '-', 'D', {DELETE} FROM (VALUES (0), (1), (2), (3)) s(p)
), steps AS (
  SELECT c, i, p, q, e, cost + CASE WHEN fault = 't' AND e <> 'D' THEN {OPEN} ELSE 0 END AS cost FROM f JOIN edits ON need = '-' OR (fault NOT IN ('b', 'd') AND (need = '*' OR need = left(role, 1)))
), way AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0 AS p, 0::BIGINT AS cost, '' AS audit FROM f
  UNION ALL
  SELECT c, i, q, (x).cost, (x).audit FROM (SELECT s.c, s.i, s.q, min({{'cost': (way.cost + s.cost)::BIGINT, 'audit': way.audit || s.e}}) AS x FROM way JOIN steps s ON s.c = way.c AND s.i = way.i + 1 AND s.p = way.p GROUP BY s.c, s.i, s.q)
), best AS (
  SELECT c, min({{'cost': (cost + {INSERT} * length(tail))::BIGINT, 'audit': audit || tail}}) AS x FROM way JOIN (SELECT c, max(i) AS n FROM f GROUP BY c) USING (c) JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) z(p, tail) USING (p) WHERE i = n GROUP BY c
), letters AS (
  SELECT c, unnest(string_split((x).audit, '')) AS e, generate_subscripts(string_split((x).audit, ''), 1) AS k FROM best WHERE (x).audit <> ''
), numbered AS (
  SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY k) AS i FROM letters
), kept AS (
  SELECT n.c, n.k, n.e, f.role, f.text, count(*) OVER (PARTITION BY n.c ORDER BY n.k) AS place, first(left(f.role, 1) = 's' AND n.e = 'K') OVER (PARTITION BY n.c ORDER BY n.k) AS system
  FROM numbered n LEFT JOIN f ON f.c = n.c AND f.i = n.i AND n.e <> 'I' WHERE n.e <> 'D'
), told AS (
  SELECT c, k, CASE e WHEN 'K' THEN role ELSE CASE WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, '') AS line FROM kept
), h AS (
  SELECT c, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM told GROUP BY c
), g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b')::BIGINT AS blank, count(*) FILTER (WHERE fault = 'd')::BIGINT AS duplicate, count(*) FILTER (WHERE fault = 't')::BIGINT AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM f GROUP BY c
)
SELECT e.conv_id, {', '.join(f'coalesce({x}, 0)::BIGINT AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce((x).cost, 0)::BIGINT AS cost, coalesce((x).audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN g ON g.c = coalesce(e.conv_id, -1) LEFT JOIN best ON best.c = coalesce(e.conv_id, -1) LEFT JOIN h ON h.c = coalesce(e.conv_id, -1)
"""
}
