"""Operators on texts with very many matches or lines: their time grows with the text."""

import time

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from engramlake.llm import common
from engramlake.llm import op1_licenses as L
from engramlake.llm import op2_pii as P
from engramlake.llm import op8_lines as D

DOCS = "doc_id long, text string"


def seconds(run):
    run()
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def test_sums_before(spark):
    for n in (0, 1, 2, 255, 256, 257, 1000):
        values = [(7 * i) % 11 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(common.sums_before("v").alias("s")).first().s
        assert got == [sum(values[:i]) for i in range(n)]


def test_many_emails_in_one_text(spark):
    def found(n):
        text = " ".join(f"mail u{i}@host{i % 97}.example, call +49 30 1234 {i:05d}; " + ("card 4111 1111 1111 1111" if i % 3 else "GB82WEST12345698765432") for i in range(n))
        row = P.find_pii(spark.createDataFrame([(1, text)], DOCS)).select(*(F.size(k).alias(k) for k in P.KINDS), "email").collect()[0]
        assert row[0] == n and row[P.BASE.index("card")] == n - -(-n // 3)
        spans = row[len(P.KINDS)]
        assert all(text[s.start : s.end].startswith(f"u{i}@") for i, s in enumerate(spans))

    few, many = seconds(lambda: found(1600)), seconds(lambda: found(16_000))
    assert many < 10 * max(few, 0.5)


def test_many_dropped_lines_in_one_document(spark):
    def dropped(n):
        text = "\n".join(f"line {i % 500}" if i % 2 else f"own {i}" for i in range(n))
        docs = [(i, text if i == 0 else "\n".join(f"line {k}" for k in range(500))) for i in range(11)]
        row = D.drop_lines(spark.createDataFrame(docs, DOCS)).filter("row.doc_id = 0").select("n_lines", "n_dropped", "text").first()
        assert (row.n_lines, row.n_dropped) == (n, n // 2) and row.text == "\n".join(f"own {i}" for i in range(0, n, 2))

    few, many = seconds(lambda: dropped(20_000)), seconds(lambda: dropped(200_000))
    assert many < 10 * max(few, 0.5)


def test_unlike_rows_whose_keys_meet_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve"), (2, "seven eight nine ten eleven twelve"), (None, None)], DOCS)
    whole = pipeline._hash
    monkeypatch.setattr(pipeline, "_hash", lambda seed, *c: F.lit(7).cast("long") if seed == 0 else whole(seed, *c))
    assert pipeline._keyed(docs).select("key").distinct().count() == 3
    assert sorted(str(r.doc_id) for r in pipeline.near_dedup(spark, docs, "").collect()) == ["1", "2", "None"]


def test_a_notice_in_a_column_of_any_width(spark):
    words = L.TEMPLATES["mit-notice"].split()
    docs = [(w, "before this\n" + "\n".join(" ".join(words[i : i + w]) for i in range(0, len(words), w)) + "\nafter that") for w in (1, 2, 3, 4, 8, 27)]
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {w: ("mit-notice", 1.0) for w, _ in docs}
    far = "\n".join(x + " other" * 40 for x in words)
    rows = L.scanned(spark.createDataFrame([(1, far)], DOCS))
    assert L.template_matches(rows).count() == 0 and L.template_matches(rows, wrap=None).filter("containment = 1").count() > 0
