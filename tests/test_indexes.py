"""Indexes, shelves, snapshots, streams of outcomes and JSON arrays, against what they stand in for."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from engramlake.operators import disclosure, memory
from engramlake.operators.ingest import DocumentStore
from engramlake.operators.memory import MemoryLog
from engramlake.operators.shelves import Shelves
from engramlake.operators.tables import Tables
from engramlake.operators.trigrams import PAGE, TrigramIndex
from engramlake.operators.vectors import VectorIndex
from engramlake.sources import corpus
from engramlake.streaming.weights import weights_stream

def now():
    return F.lit("2026-03-01 00:00:00").cast("timestamp")


PAYLOADS = "tier string, type string, payload string, tags array<string>, weight double"
ENTRY = "tier string, file string, line_no long, raw string, raw_lc string, id string, ts string, weight double, e_tier string, e_type string"


def entries(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        tier, file, kind = r.choice([("episodic", "experiences", "experience"), ("semantic", "facts", "fact"), ("procedural", "skills", "skill")])
        ts = r.choice([None, f"2026-0{r.randrange(1, 3)}-{r.randrange(10, 29)}T10:00:00Z", f"2025-{r.randrange(10, 13)}-11T00:00:00", "2027-01-01T00:00:00Z"])
        raw = json.dumps({"id": f"e{i}", "title": f"{r.choice(['Über', 'plain', 'rare' if i % 97 == 0 else 'often'])} w{i % 50} 😀x{i}"}, ensure_ascii=False)
        rows.append((tier, file, i, raw, raw.lower(), f"e{i}", ts, r.choice([0.1, 1.0, 1.0, 1.2, 5.0, round(r.uniform(0.1, 5), 4)]), tier, kind))
    return spark.createDataFrame(rows, ENTRY)


@pytest.fixture(scope="module")
def log_rows(spark):
    return entries(spark, 1500).repartition(3, "id").cache()


@pytest.fixture(scope="module")
def trigrams(spark, log_rows, tmp_path_factory):
    return TrigramIndex(spark, f"file://{tmp_path_factory.mktemp('tri')}").build(log_rows)


@pytest.mark.parametrize("query", ["rare", "über", "😀x12", "rare rare w7 nowhere", "w7", "x", "often", '"title": "über', "nowhere", "", "id title"])
def test_searches_by_trigrams(log_rows, trigrams, query):
    for options in ({}, {"tiers": ["semantic", "episodic"], "limit": 30, "min_weight": 0.5, "date_from": "2026"}):
        assert trigrams.search(query, now(), **options).collect() == memory.search(log_rows, query, now(), **options).collect()


def test_a_rare_term_reads_few_pages(trigrams):
    pages = trigrams.pages(["😀x1234"])
    assert pages.count() == 1 and trigrams.pages(["zzz"]).count() == 0 and trigrams.pages(["ab"]) is None and trigrams.pages(["title"]) is None
    assert trigrams.candidates("😀x1234").count() <= 1 << PAGE
    plan = trigrams.candidates("😀x1234")._jdf.queryExecution().toString()
    assert "In(page" in plan or "EqualTo(page" in plan or "page#" in plan.split("PushedFilters")[1][:200]


def test_batches_by_trigrams(spark, log_rows, trigrams):
    queries = spark.createDataFrame([(1, "rare w7"), (2, "often often über"), (3, "x title"), (4, ""), (5, "nowhere"), (6, "😀x77 w27 rare rare")], "query_id int, query string")
    key = lambda r: (r.query_id, r.rank)
    assert sorted(trigrams.search_batch(queries, now(), 7).collect(), key=key) == sorted(memory.search_batch(log_rows, queries, now(), 7).collect(), key=key)


def test_an_empty_index(spark, tmp_path):
    index = TrigramIndex(spark, f"file://{tmp_path}").build(spark.createDataFrame([], ENTRY))
    assert index.search("word", now()).count() == 0


def test_a_log_with_an_index_sees_later_entries_and_outcomes(spark, tmp_path):
    log = MemoryLog(spark, f"file://{tmp_path}")
    put = lambda ids: log.append(spark.createDataFrame([("semantic", "fact", json.dumps({"id": i, "subject": f"subject {i}"}), None, None) for i in ids], PAYLOADS), now())
    put([f"old-{i}" for i in range(200)])
    log.index()
    put(["new-1"])
    log.adjust(spark.createDataFrame([("semantic", "old-7", 0.9, 1), ("semantic", "new-1", 0.9, 1)], "tier string, id string, task_score double, seq long"), now())
    assert [r.score for r in log.search("old-7", now(), limit=1).collect()] == [1.1] and log.search("new-1", now()).first().score == 1.1
    assert log.search("old-199", now()).count() == 1 and log.search("subject", now(), limit=100).count() == 100
    plan = log.search("old-7", now())._jdf.queryExecution().toString()
    assert "/events" not in plan


def test_early_end_gives_the_same_rows_and_reads_less(spark, log_rows, tmp_path):
    shelves = Shelves(spark, f"file://{tmp_path}").build(log_rows, shelf=50)
    n = shelves.rows().select("shelf").distinct().count()
    for query, limit in (("title", 5), ("often", 20), ("rare w7", 10), ("nowhere", 10), ("", 10)):
        assert shelves.search(query, now(), limit=limit).collect() == memory.search(log_rows, query, now(), limit=limit).collect()
        if query == "title":
            assert len(shelves.read) < n / 2
    for day in ("2024-01-01", "2030-01-01"):
        at = F.lit(day).cast("timestamp")
        assert shelves.search("w7 rare", at, limit=9, tiers=["semantic"]).collect() == memory.search(log_rows, "w7 rare", at, limit=9, tiers=["semantic"]).collect()


# --- vectors


def points(spark, n, seed=3, dim=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [c + r.gauss(0, 0.25) for c in r.choice(centres)], f"/{'ab'[i % 2]}") for i in range(n)]
    rows += [(n + i, [0.5] * dim, "/a") for i in range(40)] + [(n + 50, [0.0] * dim, "/a"), (n + 51, None, "/a")]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>, hierarchy_path string")


def test_an_index_finds_what_a_full_search_finds(spark, tmp_path):
    v = points(spark, 1200)
    index = VectorIndex(spark, f"file://{tmp_path}").build(v, cells=30)
    queries = v.filter("doc_id % 100 = 0 AND embedding IS NOT NULL").select(F.col("doc_id").alias("query_id"), "embedding", F.when(F.col("doc_id") % 200 == 0, "/b").alias("directory"))
    known = disclosure.with_norms(v.filter("embedding IS NOT NULL"))
    assert index.recall(queries, 10, probes=4) >= 0.9
    want = sorted(map(tuple, disclosure.nearest(known, queries, 10).select("query_id", "doc_id", "score", "rank").collect()))
    assert sorted(map(tuple, index.search(queries, 10, probes=2, exact=True).select("query_id", "doc_id", "score", "rank").collect())) == want
    inside = sorted(map(tuple, disclosure.nearest(known, queries, 10, directory=True).select("query_id", "doc_id", "score", "rank").collect()))
    assert sorted(map(tuple, index.search(queries, 10, probes=2, exact=True, directory=True).select("query_id", "doc_id", "score", "rank").collect())) == inside
    # vectors that come later, and lists that a search leaves out
    more = points(spark, 60, seed=9).filter("embedding IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 5000)
    index.add(more)
    both = known.unionByName(disclosure.with_norms(more))
    want = sorted(map(tuple, disclosure.nearest(both, queries, 5).select("query_id", "doc_id", "score", "rank").collect()))
    assert sorted(map(tuple, index.search(queries, 5, exact=True).select("query_id", "doc_id", "score", "rank").collect())) == want
    with pytest.raises(ValueError, match="has some"):
        index.add(more)
    plan = index._hits(queries, index._places(queries, 1.0).filter("place < 1"), 5, False, 1.0)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [(cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:60]


def test_an_index_of_few_or_no_vectors(spark, tmp_path):
    none = points(spark, 0).filter("doc_id < 0")
    q = spark.createDataFrame([(1, [0.1] * 8), (2, [0.0] * 8)], "query_id int, embedding array<double>")
    assert VectorIndex(spark, f"file://{tmp_path}/0").build(points(spark, 1).limit(1)).search(q, 5).count() == 2
    assert VectorIndex(spark, f"file://{tmp_path}/1").build(none.unionByName(points(spark, 0).filter("doc_id = 50"))).search(q, 5).count() == 2


# --- the store


def docs(spark, ids, text):
    return spark.createDataFrame([(i, f"T {i}", "/x", "reference", [], text, [float(i.removeprefix("d")), 1.0]) for i in ids], "doc_id string, title string, hierarchy_path string, doc_type string, tags array<string>, content string, embedding array<double>")


def test_snapshots_need_no_exchange_and_miss_nothing(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}")
    store.ingest(docs(spark, ["d1", "d2", "d3"], "one"))
    store.ingest(docs(spark, ["d2"], "two"))
    listing = store.tables.appends

    def meanwhile(name):
        """An append that is done after a compaction has looked, though its name is older."""
        out = listing(name)
        if name == "documents" and not hasattr(store, "_late"):
            store._late = True
            store.tables.appends = listing
            store.ingest(docs(spark, ["d9"], "nine"))
            store.tables.appends = meanwhile
        return out

    store.tables.appends = meanwhile
    store.compact()
    store.tables.appends = listing
    assert sorted(r.doc_id for r in store.documents().collect()) == ["d1", "d2", "d3", "d9"]
    store.compact()
    for frame in (store.documents(), store.contents(), store.vectors()):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {r.l2_file_path: r.content for r in store.contents().collect()} == {"x/T_d1.md": "one", "x/T_d2.md": "two", "x/T_d3.md": "one", "x/T_d9.md": "nine"}
    store.ingest(docs(spark, ["d1", "d2"], "three"))
    store.ingest(docs(spark, ["d1"], "four"))
    assert {r.l2_file_path[3:4] + r.content for r in store.contents().collect()} >= {"_four", "_three"} or {r.content for r in store.contents().collect()} == {"one", "three", "four", "nine"}
    store.compact()
    assert store.documents().count() == 4 and store.vectors().count() == 4
    index = store.index(cells=2)
    q = spark.createDataFrame([(1, [9.0, 1.0], 4000, "q", "a")], "query_id int, embedding array<double>, token_budget int, query_text string, agent_id string")
    assert [r.doc_id for r in store.smart_query(None, q, index=index, exact=True, top_k=2).orderBy("rank").collect()] == [r.doc_id for r in store.smart_query(None, q, top_k=2).orderBy("rank").collect()]


def test_appends_without_a_common_number(spark, tmp_path):
    """Writers look at nothing that others write, so a file system's way of creating files doesn't matter; what isn't committed isn't seen."""
    tables = Tables(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(6) as pool:
        names = list(pool.map(lambda k: Tables(spark, f"file://{tmp_path}").put(spark.createDataFrame([(k,)], "k int"), "t"), range(12)))
    assert len(set(names)) == 12 and tables.appends("t") == sorted(names)
    assert tables.read("t", "k int").count() == 12
    (tmp_path / "t" / "append=99999999999999999-x").mkdir()
    spark.createDataFrame([(99,)], "k int").write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"file://{tmp_path}/t/append=99999999999999999-x")
    assert tables.read("t", "k int").count() == 12


# --- outcomes as a stream


def test_late_repeated_and_restarted_outcomes_equal_the_fold(spark, tmp_path):
    log = MemoryLog(spark, f"file://{tmp_path}/log")
    log.append(spark.createDataFrame([("semantic", "fact", json.dumps({"id": f"f{i % 20}", "n": i}), None, 1.0 + i / 10) for i in range(25)], PAYLOADS), now())
    r = random.Random(4)
    events = [("semantic", f"f{r.randrange(22)}", r.choice([0.1, 0.5, 0.9]), s, f"2026-01-01T00:00:{s:02d}") for s in range(60)]
    r.shuffle(events)
    schema = "tier string, id string, task_score double, seq long, at string"
    for n in range(3):
        part = events[n * 20 : n * 20 + 20] + events[: n * 5]  # some again
        spark.createDataFrame(part, schema).write.parquet(f"file://{tmp_path}/in/day={n}")
        weights_stream(MemoryLog(spark, f"file://{tmp_path}/log"), f"file://{tmp_path}/in/day=*").awaitTermination()
    want = memory.reinforced(log._rows(), spark.createDataFrame(events, schema))
    key = lambda df: sorted((x.id, x.line_no, x.weight) for x in df.collect())
    assert key(log.entries()) == key(want)
    assert all(json.loads(x.raw)["weight"] == x.weight for x in log.entries().collect())


# --- JSON arrays


def test_one_array_over_many_partitions(spark, tmp_path):
    r = random.Random(5)

    def value(d=0):
        k = r.randrange(8 if d < 3 else 4)
        if k < 4:
            return ["".join(r.choice('ab"\\{}[],: \n\té}') for _ in range(r.randrange(12))), r.randrange(100), None, True][k]
        return [value(d + 1) for _ in range(r.randrange(4))] if k < 6 else {f"k{i}" + r.choice(["", '"}', "\\"]): value(d + 1) for i in range(r.randrange(4))}

    whole = {f"f{i}.json": [{"id": k, "v": value()} if r.random() < 0.8 else [value(), k] for k in range(n)] for i, n in enumerate([0, 1, 2, 300])}
    for name, x in whole.items():
        (tmp_path / name).write_text(json.dumps(x, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.option("lineSep", "}").text(f"file://{tmp_path}/f3.json").rdd.getNumPartitions() > 10
        for name, x in whole.items():
            got = sorted(json.dumps(json.loads(row.raw), sort_keys=True) for row in corpus.json_export(spark, f"file://{tmp_path}/{name}").collect())
            assert got == sorted(json.dumps(v, sort_keys=True) for v in x)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    (tmp_path / "typed.json").write_text('[{"a": 1, "b": "x}"}, null, {"b": "]"}]')
    assert [tuple(x) for x in corpus.json_export(spark, f"file://{tmp_path}/typed.json", "a int, b string").collect()].count((1, "x}")) == 1


# --- paths


def test_every_ancestor_has_its_interval_and_totals(spark, tmp_path):
    from engramlake.operators.hierarchy import Hierarchy

    paths = ["/a/b", "/a/b/", "a/b/c", "/a b/x", "/a-b", "/", None, "", "/a", "//z//y", "/a/b/c/d"]
    rows = [(i, p, 10 * i) for i, p in enumerate(paths)]
    tree = Hierarchy(spark, f"file://{tmp_path}").build(spark.createDataFrame(rows, "doc_id int, hierarchy_path string, l2_tokens int"))
    nodes = {r.path: r for r in tree.directories().collect()}
    clean = ["/" + "/".join(x for x in (p or "").split("/") if x) for p in paths]
    inside = lambda p, d: d == "" or p == d or p.startswith(d + "/")
    flat = ["" if p == "/" else p for p in clean]
    assert set(nodes) == {"/".join(p.split("/")[:k]) for p in flat for k in range(1, p.count("/") + 2)}
    assert sorted(r.pre for r in nodes.values()) == list(range(len(nodes)))
    for d, r in nodes.items():
        assert r.documents == sum(inside(p, d) for p in flat) and r.tokens == sum(10 * i for i, p in enumerate(flat) if inside(p, d))
        assert {x for x, n in nodes.items() if r.pre <= n.pre <= r.last} == {x for x in nodes if inside(x, d)}
        assert sorted(x.doc_id for x in tree.subtree(d).collect()) == [i for i, p in enumerate(flat) if inside(p, d)]
    assert [r.path for r in tree.children("/a").collect()] == ["/a/b"] and tree.subtree("/none").count() == 0
    assert "GreaterThanOrEqual(pre" in tree.subtree("/a")._jdf.queryExecution().executedPlan().toString()


def test_a_stream_keeps_each_outcome_once(spark, tmp_path):
    log = MemoryLog(spark, f"file://{tmp_path}/log")
    log.append(spark.createDataFrame([("semantic", "fact", json.dumps({"id": f"f{i}"}), None, None) for i in range(5)], PAYLOADS), now())
    for n, score in enumerate((0.9, 0.1)):  # the same outcomes again, with other scores
        spark.createDataFrame([("semantic", f"f{i}", score, 1, "2026-01-01") for i in range(4)], "tier string, id string, task_score double, seq long, at string").write.parquet(f"file://{tmp_path}/in/day={n}")
        weights_stream(log, f"file://{tmp_path}/in/day=*").awaitTermination()
    assert log.tables.read("outcomes", "tier string, id string, task_score double, seq long, at string").count() == 4
    assert sorted(x.weight for x in log.entries().collect()) == [1.0, 1.1, 1.1, 1.1, 1.1]
