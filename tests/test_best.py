"""What tasks keep for each query: the same rows as one search for each, and no pair of a row and a query as a row."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import expr as E
from engramlake.operators import disclosure, memory, shelves, trigrams
from engramlake.operators.trigrams import TrigramIndex

ENTRY = "tier string, file string, line_no long, raw string, raw_lc string, id string, ts string, weight double, e_tier string, e_type string"


def now():
    return F.lit("2026-03-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def odd(spark):
    r, rows = random.Random(8), []
    for i in range(900):
        tier, file, kind = r.choice([("episodic", "failures", "failure"), ("semantic", "facts", "fact"), ("procedural", "skills", "skill")])
        raw = r.choice([None, "", "by", f"By user {i} Straße 😀{i % 7} {'abcdefghij' * (i % 3)}", f"user {i % 13}", "user by user", f"abcdefgh{i}"])
        rows.append((tier, file, i, raw, raw and raw.lower(), f"e{i}", r.choice([None, "2026-02-11T10:00:00Z", "2026-01-05T10:00:00Z"]), r.choice([None, 0.1, 1.0, 1.2]) if i % 50 == 0 else 1.0, tier, kind))
    return spark.createDataFrame(rows, ENTRY).repartition(3).cache()


TEXTS = ["by user 7", "user user by", "abcdefghij", "abcdefgh 1 by", "straße 😀3", "😀", "nothing here", "  ", "by user 7", "7 user by", "b", "abcdefghijabcdefghij by"]


def test_a_batch_gives_the_rows_of_single_searches(spark, odd):
    queries = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "query_id int, query string")
    for tiers, limit in ((None, 7), (["semantic", "episodic"], 40)):
        got: dict = {}
        for x in memory.search_batch(odd, queries, now(), limit, tiers).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(tuple(x[1:]))
        for i, text in enumerate(TEXTS):
            want = memory.search(odd, text, now(), tiers, limit).collect()
            assert got.get(i, []) == [(n + 1, *x) for n, x in enumerate(want)], text


def test_a_batch_makes_no_rows_of_pairs(spark, odd):
    plan = memory.search_batch(odd, spark.createDataFrame([(i, "user by") for i in range(3000)], "query_id int, query string"), now(), 5)
    assert "NestedLoopJoin" not in plan._jdf.queryExecution().toString()
    assert plan.count() == 15000 and plan.filter("rank = 1").select("entry", "score", "line_no").distinct().count() == 1

def test_an_index_scans_for_common_words(spark, odd, tmp_path):
    index = TrigramIndex(spark, f"file://{tmp_path}").build(odd)
    queries = spark.createDataFrame(list(enumerate([*TEXTS, *["user user"] * 500, "abcdefgh12 none", "zzz"])), "query_id int, query string")
    key = lambda r: (r.query_id, r.rank)
    found = index.search_batch(queries, now(), 6)
    assert sorted(found.collect(), key=key) == sorted(memory.search_batch(odd, queries, now(), 6).collect(), key=key)
    # equal and common words don't make a row for each query and entry
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()


def test_nearest_gives_the_rows_of_the_plain_product(spark):
    r, nan, inf = random.Random(5), float("nan"), float("inf")
    vectors = [[r.gauss(0, 1) for _ in range(6)] for _ in range(500)] + [[0.1 * (i % 4)] * 6 for i in range(60)]
    vectors += [None, [], [0.0] * 6, [1.0] * 5, [None, *[1.0] * 5], [nan] * 6, [inf, *[1.0] * 5], [1e200] * 6, [1e-200] * 6, [-1.0] * 6]
    rows = [(f"d{i * 7 % 601}", v, ("/a", "/b", None)[i % 3]) for i, v in enumerate(vectors)]
    v = disclosure.with_norms(spark.createDataFrame(rows, "doc_id string, embedding array<double>, hierarchy_path string")).cache()
    asked = [(i, vectors[j], ("/a", None)[i % 2]) for i, j in enumerate([*range(0, 560, 40), *range(558, 570)])]
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>, directory string")
    for directory, stretch in ((False, 1.0), (True, 2.0)):
        on = (F.col("directory").isNull() | F.startswith("hierarchy_path", F.col("directory"))) if directory else F.lit(True)
        pairs = v.join(q.select("query_id", F.col("embedding").alias("e"), "directory"), on)
        score = E.half_up(F.least(F.lit(1.0), E.cosine(F.col("embedding"), F.col("e"), F.col("norm"), E.norm(F.col("e"))) * stretch), 6)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        want = pairs.select("query_id", "doc_id", score.alias("score")).withColumn("rank", F.row_number().over(w)).filter("rank <= 7")
        got = disclosure.nearest(v, q, 7, directory, stretch)
        assert "NestedLoopJoin" not in got._jdf.queryExecution().toString()
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_postings_of_groups_of_pages(monkeypatch):
    r = random.Random(2)
    lines = ["".join(r.choice("ab😀é") for _ in range(r.randrange(6))) for _ in range(900)]
    page = [7 + i // 3 + (4000 if i > 400 else 0) for i in range(900)]
    want: dict = {}
    for x, p in zip(lines, page):
        for i in range(len(x) - 2):
            want.setdefault((x[i : i + 3], p >> trigrams.GROUP), set()).add(p % (1 << trigrams.GROUP))
    monkeypatch.setattr(trigrams, "PAIRS", 500)
    got: dict = {}
    batches = [pa.RecordBatch.from_arrays([pa.array(lines[i : i + 100]), pa.array(page[i : i + 100], pa.int64())], ["raw_lc", "page"]) for i in range(0, 900, 100)]
    for b in trigrams._postings(iter(batches)):
        for x in b.to_pylist():
            assert x["pages"] == sorted(set(x["pages"]))
            got.setdefault((x["gram"], x["bucket"]), set()).update(x["pages"])
    assert got == want


def test_many_shelves_come_from_few_ranges(spark, odd, tmp_path):
    rows = odd.filter("raw IS NOT NULL")
    made = shelves.Shelves(spark, f"file://{tmp_path}").build(rows, shelf=2)
    assert 300 < made.rows().select("shelf").distinct().count() and len(list((tmp_path / "rows").glob("*.parquet"))) <= shelves.RANGES
    assert not list((tmp_path / "rows").glob("shelf=*"))
    assert made.search("by user 7", now(), limit=9).collect() == memory.search(rows, "by user 7", now(), limit=9).collect()
