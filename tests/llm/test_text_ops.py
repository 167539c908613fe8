"""License, personal-data and line operators and chat formatting against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from engramlake.llm import op1_licenses as L
from engramlake.llm import op2_pii as P
from engramlake.llm import op4_chat as C
from engramlake.llm import op8_lines as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def rows(spark, values, schema=DOCS):
    return spark.createDataFrame(values, schema)


# --- licenses


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def base(t):
    w, out = words(t), []
    for p, label in L.PHRASES.items():
        k = p.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(k)] == k]
    return len(w), len(out), min((i for i, _ in out), default=None), max((i for i, _ in out), default=None), ",".join(sorted({x for _, x in out}))


LICENSES = [
    (1, "Licensed under CC BY-NC 4.0."),
    (2, "All  rights, reserved! all rights reserved"),
    (3, "cc by cc by"),
    (4, None),
    (5, ""),
    (6, "... --"),
    (7, "This work is licensed under the\nGNU General Public License, version 3."),
    (8, "Released under the MIT license"),
    (9, "accby cc byx ÉCC BY été"),
    (9, "accby cc byx ÉCC BY été"),
    (None, "all rights reserved"),
    (10, "word " * 30000 + "general public license"),
    (11, "licensed under the apache licence version 2 0"),
]


def test_licenses(spark):
    got = L.scan_licenses(rows(spark, LICENSES).withColumn("label", F.lit(1)).withColumn("words", F.lit(2))).collect()
    assert len(got) == len(LICENSES)
    want = sorted(((i, *base(t)) for i, t in LICENSES), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    by = {r.doc_id: r for r in got}
    assert by[8].labels == "mit" and by[8].score == 1.0 and by[8].n_base == 0
    assert by[11].labels == "apache-2.0" and by[11].score == 0.875
    assert by[1].labels == "cc-by,cc-by-nc" and by[6].score == 0.0
    assert L.scan_licenses(rows(spark, [])).count() == 0


def test_template_join_is_exact(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(25)]
    templates = {f"t{k}": " ".join(r.sample(vocab, r.randrange(1, 9))) for k in range(12)}
    docs = [(i, "\n".join(" ".join(r.choice(vocab + ["x"] * 5) for _ in range(r.randrange(0, 14))) for _ in range(r.randrange(1, 9)))) for i in range(120)]
    got = [(x.doc_id, x.line, x.n_lines, x.label, round(x.containment, 9)) for x in L.template_matches(L.scanned(rows(spark, docs), templates), templates, 0.6).collect()]
    want = set()
    for i, t in docs:
        lines = [line.split() for line in t.split("\n") if line.split()]
        for b in range(len(lines)):
            for n in range(1, len(lines) - b + 1):
                block = [w for line in lines[b : b + n] for w in line]
                for k, v in templates.items():
                    s = set(v.split())
                    c = len(s & set(block)) / len(s)
                    if c >= 0.6 - 1e-9 and (n == 1 or len(block) <= len(s) + L.WRAP):
                        want.add((i, b, n, k, round(c, 9)))
    assert sorted(got) == sorted(want) and len(want) > 50 and any(x[2] > 3 for x in want)


def test_wrapped_notices_are_found(spark):
    words = L.TEMPLATES["gpl-notice"].split()
    wrap = lambda n, gap="\n": gap.join(" ".join(words[i : i + n]).capitalize() for i in range(0, len(words), n))
    docs = [(1, wrap(9)), (2, f"Copyright (c) someone.\n# {wrap(7, chr(10) + '# ')}, or later.\nEnd"), (3, wrap(1)), (4, wrap(9).replace("\n", "\n" + " other words" * 30 + "\n"))]
    got = {x.doc_id: (x.labels, x.score) for x in L.scan_licenses(rows(spark, docs)).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "gpl,gpl-notice" and "gpl-notice" not in got[4][0]


# --- personal data


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(f"email:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(f"ip:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(f"card:{m.start()}:{m.end()}")
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(f"phone:{m.start()}:{m.end()}")
    return out


CASES = [
    None, "", "a@b.com_x@d.org a@b a@@b.c .@x.y é😀 mail x+y%z@q-r.s-t.uv.", "1.2.3.4.5 256.1.1.1 0255.0.0.000 1.2.3 9999999999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111",
    "+1 (555) 123-4567 +12 +1234567 +123 4567890123456 ++1 2345678", "1" * 20000, "a." * 3000 + "@", "1 " * 9000, "😀 a@b.co 4111111111111111 10.0.0.1", "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, GB00WEST12345698765432",
]


def test_pii(spark):
    r = random.Random(9)
    noise = ["".join(r.choice("01234 -.@+()ab_%") for _ in range(r.randrange(200))) for _ in range(400)]
    texts = CASES + noise + CASES[2:3]
    got = P.find_pii(rows(spark, list(enumerate(texts))).withColumn("card", F.lit("x")))
    got = got.select("row.doc_id", P.joined(*P.BASE).alias("s"), P.joined(*P.KINDS).alias("every"), "email").collect()
    assert {x.doc_id: x.s for x in got} == {i: ",".join(pii(t)) for i, t in enumerate(texts)}
    iban = next(x.every for x in got if x.doc_id == 10)
    assert iban.count("iban:") == 2 and "iban:5:" in iban
    context = next(x.email for x in got if x.doc_id == 2)
    assert max(s.score for s in context) == pytest.approx(0.95) and min(s.score for s in context) == pytest.approx(0.8)


# --- lines


def kept(docs, least=10):
    from collections import defaultdict

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    return {(i, t): [x for x in (t or "").split("\n") if not key(x) or len(seen[key(x)]) < least] for i, t in docs}


def test_lines(spark):
    r = random.Random(2)
    docs = [(i, "\n".join(r.choice(["Common line", " common LINE\t", "ÀB", "Àb", "x" + str(r.randrange(400)), "", "  ", "hot"]) for _ in range(r.randrange(1, 12)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "hot"), (103, "\n".join(["hot", "z"] * 3000)), (5, docs[5][1]), (6, "hot\nother text of the same id"), (None, "hot\nq"), (None, "q")]
    out = D.drop_lines(rows(spark, docs).withColumn("lines", F.lit(1)).withColumn("dropped", F.lit(2)))
    got = sorted(((x.row.doc_id, x.row.text, x.text, x.n_lines, x.n_dropped, x.keep_bitmap) for x in out.collect()), key=str)
    want = kept(docs)
    assert len(got) == len(docs)
    for i, t, text, n, gone, bits in got:
        lines = (t or "").split("\n")
        assert (text, n, gone) == ("\n".join(want[i, t]), len(lines), len(lines) - len(want[i, t]))
        runs = [tuple(map(int, x.split("+"))) for x in bits.split(",")] if bits else []
        assert [x for a, k in runs for x in lines[a : a + k]] == want[i, t]
    assert D.drop_lines(rows(spark, [])).count() == 0


def test_first_occurrence_is_flagged_once_in_each_salt(spark):
    seen = D.line_occurrences(rows(spark, [(i, "same\nsame") for i in range(300)]))
    x = seen.agg(F.sum("new_doc").alias("docs"), F.count_if("first").alias("firsts"), F.countDistinct("salt").alias("salts")).first()
    assert x.docs == 300 and x.firsts == x.salts


def test_first_lines_can_stay(spark):
    docs = [(i, "Same line\nown %d\nsame line" % i) for i in range(12)]
    got = {x.row.doc_id: x.text for x in D.drop_lines(rows(spark, docs), keep_first=True).collect()}
    assert got[0] == "Same line\nown 0" and all(got[i] == f"own {i}" for i in range(1, 12))


# --- chat


def test_chat(spark):
    r = random.Random(6)
    turns = [(c, t, r.choice(["user", "assistant", "system", "bob <|im_end|>"]), "é <|im_start|> " * r.randrange(3)) for c in range(6) for t in range(r.randrange(1, 150))]
    turns += [turns[0], (7, None, None, None), (7, 1, "user", "x"), (None, 0, "user", "alone"), (7, 1, "user", "tie")]
    turns += [(9, None, "user", f"no turn {i:03}") for i in range(150)] + [(9, 5, "assistant", f"at once {i:03}") for i in range(70)] * 2
    got = C.rotate(rows(spark, turns, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)).withColumn("part", F.lit(2)).withColumn("c", F.lit(2))).collect()
    by = {}
    for c, t, role, text in set(turns):
        by.setdefault(c, []).append((t if t is not None else -1, role or "unknown", text or ""))
    n = 0
    for c, said in by.items():
        for who in {m[1] for m in said}:
            text, masks, starts, seen = "", {}, {}, {}
            for m in sorted(said):
                part = -1 if m[0] < 0 else m[0] // 64
                part = part, seen.setdefault(part, 0) // 64
                seen[part[0]] += 1
                starts.setdefault(part, len(text))
                text += "<|im_start|>" + ("assistant" if m[1] == who else "user name=" + m[1].replace("<|", "<\\|")) + "\n"
                at = len(text)
                text += m[2].replace("<|", "<\\|") + "<|im_end|>"
                if m[1] == who:
                    masks.setdefault(part, []).append((at, len(text)))
                text += "\n"
            row = sorted((x for x in got if (x.conv_id, x.participant) == (c, who)), key=lambda x: (x.part, x.sub))
            assert "".join(x.text for x in row) == text and {(x.part, x.sub): x.offset for x in row} == starts
            assert {(x.part, x.sub): [tuple(y) for y in x.masks] for x in row} == {p: masks.get(p, []) for p in starts}
            n += len(row)
    assert n == len(got) and any(x.part == 2 for x in got) and any(x.sub == 2 for x in got)
    assert C.rotate(rows(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_digests_follow_the_operator(spark):
    text = "a\nb"
    got = D.drop_lines(rows(spark, [(1, text)])).select(F.sha2("text", 256)).first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()
