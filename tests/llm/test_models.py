"""GIF, pieces, toxicity and the pipeline."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from engramlake.llm import op3_toxicity as X
from engramlake.llm import op5_gif as G
from engramlake.llm import op9_pieces as P
from engramlake.llm.textnum import ALNUM, Words, mix

DOCS = "doc_id long, text string"
TEXTS = [None, "", "a", "x" * 64, "é" * 40, "word and word " * 9000, "\0\n\t", "😀🙂", "The  and   attion\nto thanedble É ▃ 梦 ᚠ"]


# --- GIF


@pytest.mark.parametrize("bits", [1, 2, 5, 8])
def test_lzw_round_trip(bits):
    r = random.Random(bits)
    for n in (0, 1, 2, 300, 9000, 70000):
        for top in {1, 2**bits}:
            data = bytes(r.randrange(top) for _ in range(n))
            assert G.lzw_unpack(G.lzw_pack(data, bits), bits) == data


def stream(codes, bits):
    """Codes packed by the rule of the format, one by one."""
    clear, size, width, out, at = 1 << bits, (1 << bits) + 2, bits + 1, 0, 0
    first = True
    for c in codes:
        out |= c << at
        at += width
        if c == clear:
            size, width, first = clear + 2, bits + 1, True
        elif first:
            first = False
        else:
            size = min(size + 1, 4096)
            if size == 1 << width and width < 12:
                width += 1
    return out.to_bytes((at + 7) // 8, "little")


def test_lzw_with_a_deferred_clear_code():
    r = random.Random(0)
    codes, table, last, data = [4], {i: bytes([i]) for i in range(4)}, None, b""
    size = 6
    for _ in range(9000):  # far beyond a full table
        c = r.choice([k for k in (r.randrange(4), r.randrange(6, size) if size > 6 else 0)])
        codes.append(c)
        data += table[c]
        if last is not None and size < 4096:
            table[size] = table[last] + table[c][:1]
            size += 1
        last = c
    assert G.lzw_unpack(stream([*codes, 5], 2), 2) == data


def gif(frames, size=(4, 3), shared=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    b = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + b"\x81\0\0" + bytes(v for c in shared for v in c)
    for left, top, w, h, pixels, delay, disposal, clear, local, laced in frames:
        b += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear >= 0)]) + delay.to_bytes(2, "little") + bytes([max(clear, 0), 0])
        b += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([(0x81 if local else 0) | (0x40 if laced else 0)]) + (bytes(v for c in local for v in c) if local else b"")
        b += b"\x02" + G._blocks(G.lzw_pack(bytes(pixels), 2))
    return b + b"\x21\xfe\x02hi\0\x3b"


def test_frames_follow_palettes_disposal_and_transparency(spark):
    grey = ((9, 9, 9),) * 4
    b = gif([(0, 0, 4, 3, [1] * 12, 5, 1, -1, None, False), (1, 1, 2, 2, [2, 0, 0, 2], 7, 2, 0, None, False), (0, 0, 1, 1, [3], 0, 3, -1, None, False), (3, 2, 1, 1, [0], 1, 0, -1, grey, False), (0, 0, 1, 3, [1, 2, 3], 1, 0, -1, None, True)])
    f = list(G.decode_gif(b))
    red, green = [255, 0, 0, 255], [0, 255, 0, 255]
    assert [x.delay_ms for x in f] == [50, 70, 0, 10, 10]
    assert f[1].canvas[1, 1].tolist() == green and f[1].canvas[1, 2].tolist() == red and f[1].canvas[0, 0].tolist() == red
    assert f[2].canvas[1, 1].tolist() == [0, 0, 0, 0] and f[2].canvas[0, 0].tolist() == [0, 0, 255, 255]
    assert f[3].canvas[0, 0].tolist() == red and f[3].canvas[2, 3].tolist() == [9, 9, 9, 255]
    assert f[4].canvas[:, 0].tolist() == [red, [0, 0, 255, 255], green]  # interlaced rows 0, 2, 1
    rows = G.gif_frames(spark.createDataFrame([(1, bytearray(b)), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(b[:60]))], "media_id long, content binary").withColumn("width", F.lit(0))).filter("media_id = 1").orderBy("frame_no").collect()
    assert [(r.frame_no, r.delay_ms, r.width, r.height) for r in rows] == [(0, 50, 4, 3), (1, 70, 4, 3), (2, 0, 4, 3), (3, 10, 4, 3), (4, 10, 4, 3)]
    assert rows[0].red == [0] * 15 + [12] and rows[2].red[15] + rows[2].red[0] == 8


def test_texts_as_gif(spark):
    docs = [*enumerate(TEXTS), (2, "a"), (None, "a")]
    got = {r.doc_id: r for r in G.media_digests(G.store_texts(spark.createDataFrame(docs, DOCS).withColumn("content", F.lit(1)))).collect()}
    for i, t in docs:
        b = (t or "").encode()
        p = b + b"\0" * ((-len(b)) % 64 or (0 if b else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert sum(map(int, r.feature.split(","))) == len(p) and r.n_frames == -(-len(p) // 65536)
    assert got[5].media_bytes < got[5].payload_bytes / 5
    assert G.media_digests(G.store_texts(spark.createDataFrame([], DOCS))).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def model():
    return P.Pieces(P.Path(P.MODEL).read_bytes())


def best_by_hand(m, s):
    """The highest sum of scores over all segmentations, position by position."""
    score = {p: v for p, v in zip(m.pieces, m.scores)}
    best = [0.0] + [None] * len(s)
    for i in range(1, len(s) + 1):
        for j in range(max(0, i - 16), i):
            if best[j] is not None and s[j:i] in score and m.auto.exists(s[j:i]):
                best[i] = max(x for x in (best[i], best[j] + score[s[j:i]]) if x is not None)
        if best[i] is None:
            best[i] = best[i - 1] + P.UNKNOWN
    return best[-1]


def total(m, ids):
    return sum(m.scores[i] for i in ids if i not in m.byte_of)


def test_viterbi_is_optimal(model):
    model.scores = model_scores()
    r = random.Random(1)
    for _ in range(200):
        s = P.MARK + "".join(r.choice("theanditionr▁éö") for _ in range(r.randrange(25)))
        assert total(model, model.best(s)) == best_by_hand(model, s)


def model_scores():
    import struct

    out = []
    for number, value in P._fields(P.Path(P.MODEL).read_bytes()):
        if number == 1:
            f = dict(P._fields(value))
            out.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
    return out


def test_same_scores_as_the_library_in_unigram_mode(model):
    """The public model's pieces and scores under the library's own best-score search: the model type in a copy of the file is switched."""
    b = P.Path(P.MODEL).read_bytes()
    at = b.index(b"\x18\x02\x20\x80\xfa\x01")  # model_type: 2, vocab_size: 32000
    lib = sentencepiece.SentencePieceProcessor(model_proto=b[:at] + b"\x18\x01" + b[at + 2 :])
    scores = model_scores()
    r = random.Random(3)
    for _ in range(150):
        t = " ".join("".join(r.choice("thanedirsouéçß,.") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 8)))
        ours, theirs = model.encode(t).tolist(), lib.encode(t)
        assert sum(scores[i] for i in ours) == sum(scores[i] for i in theirs) and lib.decode(ours) == t


def test_encode_and_decode(spark, model):
    docs = [*enumerate(TEXTS), (3, "x" * 64), (None, "null id"), (50, "a▁b"), (51, "long" * 50_000)]
    got = P.encode_texts(spark.createDataFrame(docs, DOCS).withColumn("ids", F.lit(1))).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, t in docs:
        assert by[i].n_ids == len(by[i].ids) and by[i].round_trip == (i != 50)
        if i != 50:
            assert model.decode(np.array(by[i].ids, np.int32)) == (t or "")
    assert by[8].n_bytes > 0 and by[1].n_ids == 0
    assert P.encode_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_remembered_words_change_nothing(model):
    other = P.Pieces(P.Path(P.MODEL).read_bytes())
    other.crosses = True  # whole texts in one pass
    for t in TEXTS[2:5] + TEXTS[6:]:
        assert other.encode(t).tolist() == model.encode(t).tolist()


# --- toxicity


def toy(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(3, 90))]
        y = int(r.random() < 0.3)
        if y:
            w[r.randrange(len(w))] = r.choice(["idiot", "moron", "zapling", "zaplo"])
        out.append((i, " ".join(w), y))
    return out


def test_gradients_are_right():
    net = X.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = Words([b"some words of a text " * 3, b"one", b""], ALNUM)
    v = X.vocabulary(words)
    at, live, bounds = X.windows_of(words, v)
    weight = np.linspace(-1, 1, len(at))

    def loss():
        return float(net.logits(net.inputs(v), at, live) @ weight)

    keep = {}
    x = net.inputs(v)
    net.logits(x, at, live, keep)
    g = net.gradients(v, x, at, live, keep, weight)
    r = np.random.default_rng(0)
    for k in net.p:
        flat, spots = net.p[k].reshape(-1), np.flatnonzero(g[k].reshape(-1))
        for i in r.choice(spots, min(6, len(spots)), replace=False):
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * e) == pytest.approx(g[k].reshape(-1)[i], rel=0.02, abs=2e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 24, 25, 36, 37, 100):
        s = X.window_starts(n)
        assert {i for a in s for i in range(a, min(a + X.LENGTH, n))} == set(range(n)) and len(s) >= 1


def plain_score(net, text):
    """The network's score of a text word by word and step by step, in Python's numbers."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    one = Words([text.encode()], ALNUM)
    words = [one.data[a:b].tobytes() for a, b in zip(one.start, one.end)]

    def vector(i):
        w, grams = words[i], []
        for n in X.STARTS:
            grams += [(w[:n], n)] if len(w) >= n else []
        grams += [(w[k : k + X.INNER], 99) for k in range(len(w) - X.INNER + 1)]
        rows = []
        for g, seed in grams:
            h = seed
            for c in g:
                h = (h * 257 + c) % 2**64
            rows.append(int(mix(np.array([h], np.uint64))[0]) % X.CHAR_ROWS)
        chars = sum((p["ec"][r] for r in rows), np.zeros(X.CHAR)) / max(len(rows), 1) ** 0.5
        return [*p["ew"][int(one.hash[i]) % X.WORD_ROWS], *chars]

    def states(xs, d):
        h, out, n = [0.0] * X.STATE, [], X.STATE
        for x in xs:
            a = [sum(x[i] * p[f"x{d}"][i][j] for i in range(len(x))) + p[f"c{d}"][j] for j in range(3 * n)]
            g = [sum(h[i] * p[f"u{d}"][i][j] for i in range(n)) for j in range(3 * n)]
            z, r = [sigmoid(a[j] + g[j]) for j in range(n)], [sigmoid(a[n + j] + g[n + j]) for j in range(n)]
            c = [math.tanh(a[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
            h = [c[j] + z[j] * (h[j] - c[j]) for j in range(n)]
            out.append(h)
        return out

    best = None
    for s in X.window_starts(len(words)).tolist():
        xs = [vector(i) for i in range(s, min(s + X.LENGTH, len(words)))]
        both = [f + b for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
        e = [math.exp(sum(v * a for v, a in zip(h, p["a"]))) for h in both]
        pooled = [sum(e[t] * both[t][j] for t in range(len(both))) / sum(e) for j in range(2 * X.STATE)] if both else [0.0] * (2 * X.STATE)
        logit = sum(v * w for v, w in zip(pooled, p["w"])) + p["b"][0]
        best = logit if best is None else max(best, logit)
    return sigmoid(best)


def test_scores_are_those_of_a_plain_network():
    net = X.train([d[1] for d in toy(1)[:80]], np.array([d[2] for d in toy(1)[:80]]), 1)
    texts = ["", "one", toy(1)[0][1], "Ünïcode wörds and a verylongwordwithoutanyspaceatallinit " * 9, " ".join(f"w{i}" for i in range(75))]
    assert X.score(net, texts) == pytest.approx([plain_score(net, t) for t in texts], abs=2e-5)


def test_all_windows_are_pooled_whatever_is_held_at_a_time():
    net = X.Network(2)
    encoded = [(" ".join(f"w{i % 7}" for i in range(n))).encode() for n in (0, 5, 300, 1000)]
    y = np.array([0, 1, 1, 0])
    a, b = X.text_gradients(net, encoded, y), X.text_gradients(net, encoded, y, held=10)
    assert all(np.allclose(a[k], b[k], rtol=1e-3, atol=1e-6) for k in a)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a text", 1), (1, "a text", 1), (None, None, 2)], "doc_id long, text string, `odd name, with: signs` int")
    out = X.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = [(r.row["odd name, with: signs"], r.score) for r in out.collect()]
    assert len(got) == 3 and got[0] == got[1]


def test_the_query_holds_rows_out(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(i, t) for i, t, _ in toy(4, 60)] + [(None, "x")], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in toy(4, 60)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    got = X.op3_toxicity(spark, at).collect()
    assert len(got) == 61 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)


def test_learns_words_and_word_parts(spark):
    data = toy(1)
    held = [d for d in toy(2) if d[2]] + [d for d in toy(3) if not d[2]]
    net = X.train([d[1] for d in data], np.array([d[2] for d in data]))
    s = X.score(net, [d[1] for d in held])
    y = np.array([d[2] for d in held])
    assert ((s >= X.PREDICT) == y).mean() > 0.9
    assert np.array_equal(X.train([d[1] for d in data[:60]], np.array([d[2] for d in data[:60]]), 1).p["w"], X.train([d[1] for d in data[:60]], np.array([d[2] for d in data[:60]]), 1).p["w"])
    long = "w1 " * 40_000
    a, b = X.score(net, [long, long + "idiot " + long])
    assert b > a


def test_scores_in_spark(spark, monkeypatch):
    monkeypatch.setattr(X, "EPOCHS", 1)
    rows = [(i, t, 1) for i, t, _ in toy(4, 60)] + [(100, None, 1), (101, "", 1), (3, "repeated", 1), (None, "idiot", 1), (102, "y " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in toy(4, 60)] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    out = X.score_toxicity(docs, labels)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    used, _ = X.labelled_sample(docs, labels)
    left = {t for i, t, _ in rows if i is not None and X.held_out(i)}
    assert not left & set(used) and len(used) > 20
    assert X.score_toxicity(docs.limit(0), labels).count() == 0
    assert X.score_toxicity(docs.limit(3), labels.limit(0)).count() == 3


# --- the pipeline


def test_stages_keep_what_they_should(spark, tmp_path, monkeypatch):
    """With a plain rule in the network's place, which has its own tests."""
    rule = lambda docs, labels: docs.select(F.struct("*").alias("row"), F.when(F.contains("text", F.lit("idiot")), 0.9).otherwise(0.1).alias("score"))
    monkeypatch.setattr(pipeline, "score_toxicity", rule)
    r = random.Random(8)
    fresh = lambda k: " ".join(f"v{r.randrange(300)}" for _ in range(k))
    item = fresh(30)
    base = [(i, f"{fresh(60)}\nshared line", "en", "s", 0) for i in range(60)]
    base += [(100, base[0][1], "en", "s", 0), (101, f"{fresh(20)} {item} {fresh(5)}", "en", "s", 0), (102, None, None, None, None), (103, "", "en", "s", 0), (None, fresh(9), "en", "s", 0)]
    toxic = [(200 + i, f"{fresh(20)} idiot {fresh(10)} moron idiot", "en", "s", 0) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    docs = spark.createDataFrame([(*d, 0.5, "x") for d in base + toxic], schema)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int(d[0] >= 200)) for d in base + toxic if d[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    where, at = f"file://{tmp_path}", docs
    ids = {}
    for name, stage in pipeline.STAGES:
        at = pipeline.written(stage(spark, at, where))
        ids[name] = {x.doc_id for x in at.collect()}
        if name != "pieces":
            assert at.columns == docs.columns
    keep = {d[0] for d in base}
    assert ids["toxicity"] == keep
    assert ids["line_dedup"] == ids["toxicity"]
    assert keep - ids["near_dedup"] == {100} and None in ids["near_dedup"]
    assert ids["near_dedup"] - ids["decontamination"] == {101}
    assert ids["pieces"] == ids["decontamination"]


def test_line_stage_changes_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"own {i}\nSame line", "en", "s", 99) for i in range(12)] + [(50, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.line_dedup(spark, docs, "").collect()}
    assert got[3] == ("own 3", 5) and got[50] == (None, None)


def test_near_stage_keeps_one_of_each_component(spark):
    t = " ".join(f"k{i}" for i in range(100))
    docs = spark.createDataFrame([(5, t, 1), (2, t, 1), (9, t + " more", 1), (7, "other words entirely here", 1), (8, None, 1), (1, "", 1)], "doc_id long, text string, node int")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == [1, 2, 7, 8]


def test_near_stage_takes_copies_with_words_added(spark):
    w = [f"k{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(w[:100])), (2, " ".join(w[:115])), (3, " ".join([f"x{i}" for i in range(15)] + w[:100])), (4, " ".join(w[50:] + ["z"] * 30))], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == [1, 4]


def test_stages_decide_by_row(spark, tmp_path):
    t, item = (" ".join(f"{c}{i}" for i in range(60)) for c in "ti")
    rows = [(None, t), (None, t), (None, t + " more"), (3, t), (3, t), (3, "other words of the same id"), (4, item), (4, "clean words of the same id"), (None, item), (None, "alone"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, t), rows[5], rows[6], rows[7], rows[9], (None, None), (None, None)], key=str)
    only = pipeline.near_dedup(spark, docs.filter("doc_id IS NULL AND text LIKE 't%'"), "").collect()
    assert len(only) == 1
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.text) for r in pipeline.decontamination(spark, docs, f"file://{tmp_path}").collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != item], key=str)
