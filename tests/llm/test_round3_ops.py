"""Hard negatives, conversation repair and token counts against brute force, with odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engramlake.llm import op11_negatives as N
from engramlake.llm import op12_repair as R
from engramlake.llm import op13_tokens as T

VECTORS = "vec_id long, embedding array<float>, label int"


# --- hard negatives


def plain_negatives(rows, positives=5, negatives=5):
    kept = {}
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256 * float(np.float32(c))) for c in x)
        kept.setdefault(i, set()).add(((label + 1) % 10 if i % 7 == 0 else label, v))
    out = []
    for a in sorted(i for i in kept if i % 100 == 0):
        la, va = min(kept[a])

        def best(ok, k):
            score = {}
            for i, found in kept.items():
                got = [sum(p * q for p, q in zip(va, v)) for label, v in found if i != a and len(v) == len(va) and ok(label, sum(p * q for p, q in zip(va, v)))]
                if got:
                    score[i] = max(got)
            return sorted(((s, i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]

        for ps, p in best(lambda label, s: label == la, positives):
            out += [(a, p, n + 1, i, ps, s) for n, (s, i) in enumerate(best(lambda label, s: label != la and 80 * ps <= 100 * s <= 100 * ps, negatives))]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("d", F.lit(1)).repartition(3)
    return sorted(map(tuple, N.hard_negatives(N.quantised(df)).collect()))


def vectors(seed, n, dim=5, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i * r.choice([1, 10]), [c + r.gauss(0, 0.4) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors(1, 700)
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and len(got) > 100


def test_hard_negatives_with_ties_nulls_dimensions_and_repeated_rows(spark):
    rows = vectors(2, 150) + [(1000 + i, [0.5] * 5, i % 3) for i in range(400)]  # one vector many times
    rows += [(100, [0.5] * 5, 0), (100, [0.5] * 5, 0), (200, None, 1), (300, [1.0, None, 1.0, 1.0, 1.0], 1), (400, [float("nan")] * 5, 1), (500, [float("inf")] * 5, 1), (600, [1.0] * 5, None)]
    rows += [(700 + i, [0.1, 0.2], i % 2) for i in range(9)] + [(800, [], 0), (801, [], 0), (802, [], 1), (900, [-1.0] * 5, 8), (901, [0.0] * 5, 8)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_no_rows_give_no_negatives(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_scores_that_fit_no_long_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1)])


def test_anchors_go_through_in_blocks(spark, monkeypatch):
    rows = vectors(3, 400)
    monkeypatch.setattr(N, "ANCHORS", 4)
    assert mined(spark, rows) == plain_negatives(rows)


def test_brackets_hold_every_score():
    r = np.random.default_rng(0)
    rows, asked = r.integers(-300, 300, (200, 8)), r.integers(-300, 300, (7, 8))
    p = N.Pivots(rows[:40], float((rows.astype(float) ** 2).sum(axis=1).max()))
    scan = N._Scan(p, {"v": asked, "id": np.arange(7)})
    d = p.distances(p.lifted(rows))
    low, high = scan.brackets(d, d, np.arange(7))
    exact = scan.scores(rows, np.arange(7))
    assert (exact == asked @ rows.T).all() and (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.9 * (scan.square.max() + p.longest)  # they tell something


# --- conversation repair


def cheapest(word):
    """The least (cost, audit) by search over edits, without the grammar's chart."""
    heap, best = [(0, "", 0, "")], None
    while heap and (best is None or heap[0][0] <= best[0]):
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(word) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if not re.fullmatch("s?(ua)*u?", roles) or cost > 4 * len(word) + 3:
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
        if i < len(word):
            x = word[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if x not in R.GONE:
                more = 3 * (x in R.BROKEN)
                if x.lower() != "x":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + x.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r))
    return best


def test_parse_equals_a_search_over_edits():
    r = random.Random(3)
    for n in range(1, 6):
        for _ in range(60):
            w = "".join(r.choice("suaxSUAX013") for _ in range(n))
            assert R.parse(w)[1] == cheapest(w), w


def test_stretches_give_the_whole_repair():
    r = random.Random(4)
    for _ in range(300):
        w = "".join(r.choice("suuaaxUA1") for _ in range(r.randrange(2, 40)))
        cut = sorted(r.sample(range(1, len(w)), min(len(w) - 1, r.randrange(1, 5))))
        parts = [w[a:b] for a, b in zip([0, *cut], [*cut, len(w)])]
        sums = [R.summary(x) for x in parts]
        whole = R.compose(sums)
        if len(parts) > 2:
            assert whole == R.compose([R.compose(sums[:2]), R.compose(sums[2:])])
        q = R.last_state(*whole)
        audit = "".join(R.parse(x, R.STATES[a])[0][R.STATES[b]][1] for x, (a, b) in zip(parts, R.trace(sums, 0, q)))
        assert audit + R.TAILS[R.STATES[q]] == R.parse(w)[1][1]


def plain_repair(rows):
    """The digest of each conversation, row by row."""
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = convs.setdefault(c, [])
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            mine += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for c, mine in convs.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        faults, seen = [], set()
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        place = ["suax".index(r[:1]) if r[:1] in ("s", "u", "a") else 3 for _, r, _ in mine]
        word = "".join((R.GONE if f in ("b", "d") else R.BROKEN if f else R.FINE)[i] for f, i in zip(faults, place))
        cost, audit = cheapest(word) if len(word) < 7 else R.parse(word)[1]
        lines, rest, last = [], iter(mine), ""
        for e in audit:
            t, role, text = (None, None, "") if e == "I" else next(rest)
            if e != "D":
                role = role if e == "K" else "assistant" if last == "u" else "user"
                lines, last = [*lines, f"{role}:{text}"], role[0]
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


def talk(seed, convs, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "What?", " ", "", "\t\n", "é.", None, "Yes. ", "a "]
    return [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]), r.choice(texts)) for c in range(convs) for t in sorted(r.sample(range(3 * most), r.randrange(0, most)))]


def test_repair_equals_row_by_row(spark):
    rows = talk(5, 120, 6) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (7, None, "system", "S."), (8, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).withColumn("at", F.lit(1)).withColumn("edit", F.lit("K"))
    df.createOrReplaceTempView("x")
    got = {r.conv_id: tuple(r)[1:] for r in R.digests(R.repaired(R.damaged(df.repartition(5)))).collect()}
    want = plain_repair(rows)
    assert got == {c: v for c, v in want.items() if c in got} and all(v[6] == "" and v[5] == 0 for c, v in want.items() if c not in got)


def test_a_long_conversation_goes_by_stretches_and_over_partitions(spark):
    r = random.Random(6)
    rows = [(1000, t, r.choice(["user", "assistant", "system"]), r.choice(["A.", "B", "C?", f"{t}."])) for t in range(700)] + talk(7, 20, 5)
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    want = plain_repair(rows)
    for bits in (2, 5):
        got = {x.conv_id: tuple(x)[1:] for x in R.digests(R.repaired(R.damaged(df), bits=bits)).collect()}
        assert got == {c: v for c, v in want.items() if c in got} and 1000 in got


def test_repaired_conversations(spark):
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "user", "Well?"), (1, 3, "user", "Well?"), (2, 1, "user", "a")]
    got = [tuple(r) for r in R.repaired(spark.createDataFrame(rows, TURNS)).orderBy("conv_id").collect()]
    assert [(c, e, f, r, t) for c, e, f, _, _, r, t in got] == [
        (1, "D", None, "assistant", "Hi."), (1, "D", None, "user", "Well?"), (1, "D", "duplicate", "user", "Well?"), (2, "D", "truncated", "user", "a"),
    ] or [x[1] for x in got if x[0] == 1] == list(R.parse("au1")[1][1])


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert R.repaired(empty).count() == 0 and R.digests(R.repaired(R.damaged(empty))).count() == 0


def test_conversations_that_lose_all_rows_are_kept(spark, tmp_path):
    gone = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(5, gone, "user", "Hi.")], TURNS).write.parquet(f"file://{tmp_path}/conversations.parquet")
    row = R.op12_conversation_repair(spark, f"file://{tmp_path}").collect()
    assert [tuple(r) for r in row] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- token counts


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(T.MODEL))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def steps():
    with open(public_tokenizers.path(T.MODEL), "rb") as f:
        return T.Steps(f.read())


POOLS = ["abcdefghij klmnop'qrstuvwxyz", "aaaaab'", "é̂̈a̧ñẩÅ ", "각가ㄱ한국어각", "<|endoftext|>", "ไทยภาษาุ่้", "İIıΣσς'’ẞß", "0123½²٣ ", "!!!???---===''' ", "😀👍🏽‍👩", "日本語テスト。が", "<|startoftext|><|endoftext|> a'S'RE'Ve"]
EXTRA = ["<|endoftext|>", "'re", "'ll", "don't", "we'LL", "ing", " ", "　", "\x1c", "\x85"]


def test_every_prefix_has_the_librarys_count(steps, library):
    r = random.Random(1)
    for _ in range(700):
        pool = "".join(r.sample(POOLS, r.choice([1, 1, 2, 3])))
        x = "".join(r.choice(pool) for _ in range(r.randrange(1, 24)))
        i = r.randrange(len(x) + 1)
        x = x[:i] + r.choice(EXTRA) + x[i:] if r.random() < 0.3 else x
        assert steps.steps(x).cumsum().tolist() == [library(x[: k + 1]) for k in range(len(x))], x


def test_long_words_and_texts_go_through_in_parts(steps, library, monkeypatch):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(20_000)), "=" * 9000, "é" * 5000, "日本" * 3000, "a" * 7000 + "<|endoftext|>" + "b" * 300]
    for x in words:
        got = steps.steps(x).cumsum()
        assert got[-1] == library(x)
        for k in [r.randrange(1, len(x)) for _ in range(6)]:
            assert got[k - 1] == library(x[:k])
    text = " ".join(words) + "\n" + "the end. " * 500
    whole = steps.steps(text)
    monkeypatch.setattr(T, "PART", 1000)
    assert (steps.steps(text) == whole).all() and whole.sum() == library(text)


def test_what_is_remembered_has_a_bound(steps, library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    text = " ".join(f"w{i}ord é{i}" for i in range(300))
    assert steps.steps(text).sum() == library(text) and len(steps._known) <= 11


def test_easy_code_points_are_as_the_library_has_them(steps):
    for c in map(chr, range(0x10000)):
        if not T.easy(c):
            continue
        low = steps.lower.normalize_str(steps.compose.normalize_str(c))
        assert low == c.lower(), hex(ord(c))
        if steps.blank.match(low):
            assert not steps.words(c)
        else:
            kind = steps._kind(low)[0]
            found = steps.pretokens.match(low * 2).end()
            assert (kind == T.NUMBER) == (found == 1) and (kind == T.LETTER) == (steps.pretokens.match(f"a{low}").end() == 2), hex(ord(c))


def test_token_counts_of_rows(spark, library):
    texts = [None, "", " ", "Hello, world!", "Hello, world!", "<|endoftext|> it's\r\n\tdone", "é" * 50, "the cat sat on the mat " * 900]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y", 2)], "doc_id long, text string, n_tokens int")
    rows = T.token_counts(df).withColumn("first", T.tokens_before(F.col("steps"), 7)).withColumn("fits", T.longest_prefix(F.col("steps"), 3)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and got[None].n_tokens == 2
    for i, t in enumerate(texts):
        t = t or ""
        counts = [library(t[:k]) for k in range(min(len(t), 120) + 1)]
        assert (got[i].n_bytes, got[i].n_tokens, len(got[i].steps)) == (len(t.encode()), library(t), len(t))
        assert got[i].first == library(t[:7]) and got[i].fits == max(k for k, n in enumerate(counts) if n <= 3)
    assert T.token_counts(df.limit(0)).count() == 0


def test_words_fall_and_rise(steps):
    """A longer word may have fewer tokens, so the last place that fits a budget isn't the first that doesn't."""
    x = steps.steps("unbelievable")
    assert (x < 0).any() and x.sum() < x.cumsum().max()
