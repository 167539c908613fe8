"""Similarity joins, passages, decontamination and components against brute force."""

import itertools
import random
import re
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engramlake.llm import op6_passages as S
from engramlake.llm import op7_ngrams as N
from engramlake.llm import op10_tiling as T
from engramlake.llm import simjoin as J
from engramlake.llm.bits import filter_of, filters, passes
from engramlake.llm.common import connected_components
from engramlake.llm.simjoin import PrefixTree
from engramlake.llm.textnum import ALNUM, Words

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400), (500, 501), (500, 501)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = roots(600, edges)
    assert got == {i: want[i] for e in edges for i in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_filter(spark):
    ids = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    bits = filter_of(spark.createDataFrame([(int(i),) for i in ids[:1000]] + [(None,)], "id long"))
    assert passes(bits, ids[:1000]).all() and passes(bits, ids[1000:]).mean() < 0.01


def test_bit_filters_in_parts(spark):
    rows = spark.range(200).select((F.col("id") * 7919).alias("key"))
    parts = filters(rows, rows.filter("key % 3 = 0"), "key", most=10)
    assert len(parts) == 7
    got = [(r.key, bool(passes(held.value, np.array([r.key], np.int64))[0])) for part, held in parts for r in part.collect()]
    assert len(got) == 200 and all(ok for k, ok in got if k % 3 == 0) and sum(ok for _, ok in got) < 75
    assert len(filters(rows, rows, "key")) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), max_size=14), max_size=25), st.sampled_from([(90, 100), (80, 100), (50, 100)]))
def test_prefix_tree_finds_all_links(sets, ratio):
    num, den = ratio
    sets = sorted((sorted(s) for s in sets), key=len)
    tree = PrefixTree(num, den)
    for s in sets:
        tree.add(s)
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and den * len({*sets[a]} & {*sets[b]}) >= num * len({*sets[a]} | {*sets[b]})]
    assert [tree.label(i) for i in range(len(sets))] == roots(len(sets), links)


def linked(a, b, num, den):
    return den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]))
def test_linked_sets_share_a_key_and_pass_the_signature(n, change, seed, ratio):
    num, den = ratio
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(-(2**63), 2**63 - 1, n))
    gone = r.random(len(a)) < change / (2 * n)
    b = np.unique(np.concatenate([a[~gone], r.integers(-(2**63), 2**63 - 1, int(gone.sum()) + r.integers(0, change // 4 + 1))]))
    if len(b) and linked(a, b, num, den):
        size = N.prefix(np.array([len(a), len(b)]), num, den)
        assert set(a[: size[0]]) & set(b[: size[1]])
        two = sorted((a, b), key=len)
        sigs = J.signatures(np.concatenate(two), np.cumsum([0, len(two[0]), len(two[1])]))
        assert J.may_link(np.array([len(x) for x in two]), sigs, num, den).all()


def test_signatures_reject_what_differs():
    r = np.random.default_rng(2)
    sets = sorted((np.unique(r.integers(-(2**63), 2**63 - 1, int(n))) for n in r.integers(20, 900, 60)), key=len)
    sigs = J.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert not J.may_link(np.array([len(s) for s in sets]), sigs, 80, 100).any()


def test_shared_keys_name_every_node_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(J, "PACK", 50)  # several rows and meetings a bucket
    r = random.Random(4)
    nodes = [(i, sorted(r.sample(range(120), r.randrange(0, 6)))) for i in range(200)] + [(999, [7] * 1), (1000, [])]
    postings = J.packed(spark.createDataFrame(nodes, "node long, keys array<long>").repartition(3))
    got = {(x.hub, x.node) for x in J.shared_keys(postings).collect()}
    by = {}
    for i, keys in nodes:
        for k in keys:
            by.setdefault(k, set()).add(i)
    assert {x.hub for x in J.shared_keys(postings.withColumn("alone", F.lit(True))).collect()} == {k for k, v in by.items() if len(v) > 1}
    groups = {}
    for hub, node in got:
        groups.setdefault(hub, {hub}).add(node)
    # the nodes of a key are one group's, and no group has a node without a key of its hub
    assert all(any(v <= g for g in groups.values()) for v in by.values() if len(v) > 1)
    assert all(set(dict(nodes)[h]) & set(dict(nodes)[n]) for h, n in got)


def test_frequent_grams_come_last(spark):
    docs = [(f"common words that all of them share {i} own{i} text{i} here{i} too{i}",) for i in range(40)]
    classes = N.frequency_classes(spark.createDataFrame(docs, "text string"), 3)
    tokens, bounds = N.Grams([docs[0][0].encode()], 3).sets(classes, 1)
    shared = {x for d in docs[1:2] for x in N.Grams([d[0].encode()], 3).sets(classes, 1)[0].tolist()}
    assert [t in shared for t in tokens.tolist()] == [False] * 5 + [True] * 5 and bounds.tolist() == [0, 10]


def test_a_word_before_or_after_a_short_text_is_no_barrier(spark):
    w = [f"t{i}" for i in range(12)]
    docs = [(1, " ".join(w[:11])), (2, " ".join(w)), (3, " ".join(w[1:])), (4, " ".join(w[:10]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: (9, 1), 2: (10, 1), 3: (9, 1), 4: (8, 4)}


def corpus(seed, groups=12, copies=6):
    r = random.Random(seed)
    docs = []
    for _ in range(groups):
        w = [f"W{r.randrange(3000)}" for _ in range(r.choice([1, 2, 3, 9, 12, 60, 150, 400]))]
        for _ in range(r.randrange(1, copies)):
            x = list(w)
            for _ in range(r.randrange(0, 1 + len(x) // 40)):
                x[r.randrange(len(x))] = f"e{r.randrange(10**6)}"
            docs.append(" ".join(x))
    return docs


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_are_exact(spark):
    texts = [*corpus(8), None, "", " \n", "One two", "one\tTWO", "x" * 100_000]
    big = " ".join(f"g{i}" for i in range(300))
    r = random.Random(3)
    for _ in range(60):  # one large group, each a few words from the same text
        w = big.split()
        for _ in range(r.randrange(3)):
            w[r.randrange(300)] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += texts[5:9]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in enumerate(roots(len(texts), links))}
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("node", F.lit(1)).withColumn("keys", F.lit(2))
    for block in (2048, 7):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, block=block).collect()}
        assert got == want
    rows = [(None, texts[0]), (3, texts[0]), (3, texts[0]), (3, "quite another text here"), (4, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles > 0, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, True, 3), (3, True, 3), (3, True, 3), (3, True, 3), (4, False, 4), (None, False, None)], key=str)
    w = [f"n{i}" for i in range(60)]
    rows = [(5, " ".join(w)), (None, " ".join([*w, "a", "b"])), (6, " ".join([*w, "a", "b", "c", "d", "e"])), (None, "alone of its kind"), (None, "alone of its kind")]
    got = sorted(((r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(5, 5), (None, 5), (6, 5), (None, None), (None, None)], key=str)  # 5 and 6 are linked by the row without an id alone
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def sentence(r, n):
    return " ".join(f"s{r.randrange(4000)}" for _ in range(n)).capitalize() + "."


def test_passages(spark):
    r = random.Random(5)
    fresh = lambda k: " ".join(sentence(r, r.randrange(6, 20)) for _ in range(k))
    passage = fresh(5)
    docs = [(i, fresh(4)) for i in range(20)] + [(100 + i, f"{fresh(2)} {passage} {fresh(1)}") for i in range(6)] + [(200, None), (201, ""), (202, "A b. " * 4000), (203, passage), (204, passage.replace(".", ".\n"))]
    near = passage.split()
    near[12] = "changed"
    docs += [(205, fresh(1) + " " + " ".join(near)), (300, "very" + " long" * 50_000)]
    got = S.repeated_passages(spark.createDataFrame([*docs, docs[20]], DOCS).withColumn("node", F.lit(0)).withColumn("keys", F.lit(1))).collect()
    assert {x.doc_id for x in got} == {*range(100, 106), 203, 204, 205}
    text = dict(docs)
    for x in got:
        if x.doc_id < 106:
            assert text[x.doc_id][x.start : x.end] in passage and x.n_words > 40
    assert sum(x.n_removed == 0 for x in got) == 1
    assert S.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def brute_passages(docs, least):
    """By document the word ranges that stand in another one too, from least words in a row."""
    at = {}
    for i, w in docs.items():
        for k in range(len(w) - least + 1):
            at.setdefault(tuple(w[k : k + least]), set()).add((i, k))
    out = {}
    for places in at.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                out.setdefault(i, set()).update(range(k, k + least))
    return out


def test_every_repeat_of_51_words_is_found_wherever_it_stands(spark):
    r = random.Random(21)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    docs = {}
    for k in range(40):
        passage, broken = fresh(r.choice([20, 30, 45, 51, 52, 60, 90, 200])), r.random() < 0.3
        for _ in range(r.choice([1, 2, 2, 3])):
            w = fresh(r.randrange(0, 80)) + passage + fresh(r.randrange(0, 80))  # amid words, without any sentence's end
            docs[len(docs)] = (w, "\n" if broken else " ")
    rows = [(i, "".join(x + (gap if j % 5 == 4 else " ") for j, x in enumerate(w))) for i, (w, gap) in docs.items()]
    got, text = {}, dict(rows)
    for x in S.repeated_passages(spark.createDataFrame(rows, DOCS)).collect():
        before = len(text[x.doc_id][: x.start].split())
        got.setdefault(x.doc_id, set()).update(range(before, before + x.n_words))
        assert text[x.doc_id][x.start : x.end].split() == docs[x.doc_id][0][before : before + x.n_words]
    want = brute_passages({i: w for i, (w, _) in docs.items()}, 51)
    # exactly their words, but where a paragraph with a few words more is near enough
    assert all(want[i] <= got.get(i, set()) and len(got[i] - want[i]) < 10 for i in want) and len(want) > 20
    assert sum(want[i] == got[i] for i in want) > 0.8 * len(want)
    shorter = brute_passages({i: w for i, (w, _) in docs.items()}, S.MIN_WORDS)
    assert set(got) <= set(shorter)


def test_edited_passages_and_short_lines(spark):
    r = random.Random(22)
    lines = [" ".join(f"v{r.randrange(10**6)}" for _ in range(r.randrange(2, 7))) for _ in range(30)]
    near = [sentence(r, 60) for _ in range(2)]
    changed = [n.replace(n.split()[50], "other") for n in near]
    fresh = lambda: sentence(r, 30)
    docs = [(1, "\n".join([fresh(), *lines, fresh()])), (2, "\n".join([fresh(), *lines])), (3, f"{fresh()} {' '.join(near)} {fresh()}"), (4, f"{' '.join(changed)} {fresh()}"), (5, "\n".join(lines[:4] + [fresh()])), (6, fresh())]
    got = S.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {x.doc_id for x in got} == {1, 2, 3, 4}
    assert {x.doc_id: x.n_words for x in got if x.doc_id < 3} == dict.fromkeys((1, 2), sum(len(x.split()) for x in lines))


def test_long_enough_keeps_what_may_grow_together():
    a = lambda *x: np.array(x, np.int64)
    keep = S.long_enough(a(0, 10, 40, 100, 130), a(10, 20, 50, 126, 135), a(0, 0, 0, 90, 90), a(90, 90, 90, 140, 140), a(0, 0, 0, 26, 0), 45)
    assert keep.tolist() == [False, False, False, True, True]
    assert S.long_enough(*[a()] * 5, 9).tolist() == []


def greedy(doc, item, least):
    """Tiling by the definition: the longest match of unmarked words, again and again."""
    least = min(least, len(item))
    out, a, b = [], [False] * len(doc), [False] * len(item)
    while least:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return out
        a[i : i + n] = b[j : j + n] = [True] * n
        out.append((i, j, n))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=16), st.integers(2, 5))
def test_tiles_are_greedy(doc, item, least):
    got = T.tiles(np.array(doc, np.int64), np.array(item, np.int64), least)
    want = greedy(doc, item, least)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
    assert all(doc[i : i + n] == item[j : j + n] for i, j, n in got)


def test_tiles_of_repetitive_texts_take_little():
    same = np.full(200_000, 7, np.int64)
    tracemalloc.start()
    assert T.tiles(same, same[:200]) == [(0, 0, 200)]
    assert T.tiles(np.tile(np.arange(3), 60_000), np.tile(np.arange(3), 70)[1:]) == [(1, 0, 209)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_decontamination(spark):
    r = random.Random(7)
    item = [f"q{r.randrange(900)}" for _ in range(40)]
    text = lambda w: " ".join(w)
    fresh = [f"f{i}" for i in range(30)]
    docs = [
        (1, text(fresh + item + fresh)),
        (2, text(item[20:] + fresh + item[:20])),  # reordered
        (3, text(fresh)),
        (4, text(fresh + item[:12] + fresh)),  # too little
        (5, None),
        (6, ""),
        (7, text(item).upper().replace(" ", ", ")),
        (1, text(item)),
        (8, "alpha beta"),
        (None, text(item)),
        (9, text(fresh * 3000 + item)),
    ]
    items = [(10, text(item)), (11, text(item)), (12, None), (13, "..."), (14, "Alpha, beta")]
    got = sorted(((x.doc_id, x.item_id, x.n_tiles, x.coverage) for x in T.contaminated(spark.createDataFrame(docs, DOCS).withColumn("words", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 10, 1, 1.0), (1, 10, 1, 1.0), (2, 10, 2, 1.0), (7, 10, 1, 1.0), (8, 14, 1, 1.0), (None, 10, 1, 1.0), (9, 10, 1, 1.0)], key=str)
    assert T.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert T.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_words_and_grams():
    texts = ["Ab cd\tEF  gh", "", "é", "x" * 200 + " y", "a b c d e f"]
    w = Words([t.encode() for t in texts])
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] == ["ab", "cd", "ef", "gh", "é", "x" * 200, "y", *"abcdef"]
    grams, bounds = w.grams(3)
    assert np.diff(bounds).tolist() == [2, 0, 0, 0, 4]
    assert len({*Words([b"a b c", b"c b a", b"a b c"]).grams(3)[0].tolist()}) == 2
    assert [len(x) for x in (Words([b"a-b, c"], ALNUM).hash, Words([b"a-b, c"]).hash)] == [3, 2]
