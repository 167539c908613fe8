import json

import pytest
from pyspark.sql import functions as F

from engramlake.functions import expr as E
from engramlake.operators import memory
from engramlake.operators.memory import MemoryLog
from engramlake.sources import corpus, jsonl


def now():
    return F.lit("2026-03-01 12:00:00+00:00").cast("timestamp")


def entries(spark, lines, tier="episodic", file="experiences"):
    rows = [(tier, file, i + 1, x) for i, x in enumerate(lines)]
    return jsonl.parse(spark.createDataFrame(rows, "tier string, file string, line_no long, line string"))


def line(**fields):
    return json.dumps(fields, ensure_ascii=False)


def test_bad_lines_and_headers_are_skipped(spark):
    lines = ["not-json", '{"schema": "header"}', line(id="1", ts="2026-02-26T12:00:00+00:00", title="valid line", weight=1.0), "", '{"schema": null}', "[1]", "7", '"schema"', '{"weight": null, "id": "x"}', '{"ts": 5}']
    e = entries(spark, lines)
    assert [(r.id, r.line_no) for r in e.collect()] == [("1", 3)]
    raw = spark.createDataFrame([("episodic", "experiences", i, x) for i, x in enumerate(lines)], "tier string, file string, line_no long, line string")
    assert jsonl.malformed(raw).first().malformed == 6
    hit = memory.search(e, "valid", now()).collect()
    assert len(hit) == 1 and hit[0].line_no == 3


def test_scores_rank_by_ratio_weight_and_recency(spark):
    ts = "2026-02-26T12:00:00+00:00"
    e = entries(spark, [line(id="e", ts=ts, title="fixed AOMS", weight=1.0), line(id="f", ts=ts, subject="AOMS retrieval", weight=1.0), line(id="s", ts=ts, skill_name="retrieval x", weight=1.2)])
    got = memory.search(e, "AOMS retrieval degraded", now()).collect()
    assert [json.loads(r.entry)["id"] for r in got] == ["f", "s", "e"]
    assert got[0].score == round(2 / 3 * 0.995**3, 4)


def test_keys_match_and_repeated_terms_count(spark):
    e = entries(spark, [line(id="a", weight=1.0), line(id="b", note="weight weight", weight=2.0)])
    assert memory.search(e, "weight", now()).count() == 2
    assert memory.search(e, "weight zzz weight", now()).first().score == round(2 / 3 * 2.0, 4)
    assert memory.search(e, "  ", now()).count() == 0


def test_recency(spark):
    cases = {"2026-02-26T12:00:00+00:00": 0.995**3, "2026-02-26T12:00:00Z": 0.995**3, "2026-02-26T12:00:01Z": 0.995**2, "2026-02-26T12:00:00": 1.0, "2026-02-26": 1.0, "": 1.0, "rubbish": 1.0, None: 1.0, "2027-01-01T00:00:00Z": 1.0, "2026-02-26T14:00:00+02:00": 0.995**3}
    df = spark.createDataFrame([(k,) for k in cases], "ts string").select("ts", E.recency(F.col("ts"), now()).alias("r"))
    assert {r.ts: r.r for r in df.collect()} == pytest.approx(cases)
    forms = spark.createDataFrame([("2026-02-26T12:00Z",), ("20260226T120000Z",), ("2026-02-26T12:00:00+00",)], "ts string")
    assert [round(r[0], 9) for r in forms.select(E.recency(E.normal_time(F.col("ts")), now())).collect()] == [round(0.995**3, 9)] * 3


def test_date_filters_compare_text_and_missing_times(spark):
    e = entries(spark, [line(id="a", ts="2026-02-28T10:00:00Z"), line(id="b"), line(id="c", ts="2026-02-27")])
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(memory.filtered(e, date_to="2026-02-28")) == ["b", "c"]
    assert ids(memory.filtered(e, date_from="2026-02-27")) == ["a", "c"]
    assert ids(memory.filtered(e, min_weight=1.1)) == []
    assert ids(memory.filtered(e, min_weight=0.0, date_from="")) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        memory.filtered(e, ["working"])
    with pytest.raises(ValueError):
        memory.search(e, "a", now(), limit=101)


def test_weights(spark):
    df = spark.createDataFrame([(None, "decision"), (None, "experience"), (9.0, "fact"), (0.0, "fact"), (None, None)], "w double, k string")
    assert [r[0] for r in df.select(E.initial_weight(F.col("w"), F.col("k"))).collect()] == [1.2, 1.0, 5.0, 0.1, 1.0]
    step = spark.createDataFrame([(1.0, 0.7), (1.0, 0.3), (1.0, 0.71), (1.0, 0.29), (5.0, 1.0), (0.1, 0.0)], "w double, s double")
    assert [r[0] for r in step.select(E.reinforce(F.col("w"), F.col("s"))).collect()] == [0.995, 0.995, 1.1, 0.9, 5.0, 0.1]
    fold = spark.createDataFrame([(1.2, [1.0, 0.0]), (1.2, [0.0, 1.0])], "w double, s array<double>")
    assert [r[0] for r in fold.select(E.reinforce_all(F.col("w"), F.col("s"))).collect()] == [1.188, 1.188]


def test_exact_fold_rounds_as_python(spark):
    import random

    r = random.Random(5)
    rows = [(r.choice([0.8, 1.0, 1.2]), [r.random() for _ in range(r.randrange(1, 30))]) for _ in range(200)]

    def one(w, scores):
        for s in scores:
            w = round(max(0.1, min(5.0, w * (1.1 if s > 0.7 else 0.9 if s < 0.3 else 0.995))), 4)
        return w

    df = spark.createDataFrame(rows, "w double, s array<double>").coalesce(1)
    assert [x[0] for x in df.select(memory.exact_fold(F.col("w"), F.col("s"))).collect()] == [one(*x) for x in rows]


def test_reinforcement_hits_all_rows_of_the_first_file_only(spark):
    e = entries(spark, [line(id="x"), line(id="x"), line(id="y")]).union(entries(spark, [line(id="x")], file="decisions"))
    events = spark.createDataFrame([("episodic", "x", 1.0, 1), ("episodic", "x", 0.0, 2), ("semantic", "y", 1.0, 1)], "tier string, id string, task_score double, seq long")
    got = {(r.file, r.line_no): r.weight for r in memory.reinforced(e, events).collect()}
    assert got == {("experiences", 1): 0.99, ("experiences", 2): 0.99, ("experiences", 3): 1.0, ("decisions", 1): 1.0}


def test_ties_keep_tier_file_and_line_order(spark):
    e = entries(spark, [line(id="1"), line(id="2")]).union(entries(spark, [line(id="3")], "semantic", "facts")).union(entries(spark, [line(id="4")], file="decisions"))
    order = lambda tiers: [json.loads(r.entry)["id"] for r in memory.search(e, "id", now(), tiers).collect()]
    assert order(None) == ["1", "2", "4", "3"]
    assert order(["semantic", "episodic"]) == ["3", "1", "2", "4"]


def test_search_batch_equals_single_searches(spark):
    e = entries(spark, [line(id=str(i), ts=f"2026-02-{i % 28 + 1:02}T00:00:00Z", title=f"word{i % 5} word{i % 3}", weight=1 + i % 4 / 10) for i in range(60)])
    texts = ["word1", "word2 word0", "nothing", "", "word1 word1 id"]
    got = memory.search_batch(e, spark.createDataFrame(list(enumerate(texts)), "query_id int, query string"), now(), 7)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.entry, r.score))
    for i, t in enumerate(texts):
        assert by.get(i, []) == [(r.entry, r.score) for r in memory.search(e, t, now(), limit=7).collect()]


def payloads(spark, rows):
    return spark.createDataFrame(rows, "tier string, type string, payload string, tags array<string>, weight double")


def test_log_round_trip(spark, tmp_path):
    log = MemoryLog(spark, f"file://{tmp_path}/log")
    assert log.total() == 0 and log.search("x", now()).count() == 0
    log.append(payloads(spark, [("episodic", "experience", line(ts="2026-02-26T12:00:00+00:00", title=f"event-{i} é"), ["t"], None) for i in range(250)]), now())
    log.append(payloads(spark, [("semantic", "fact", line(id="own", subject="s", weight=9, tags=["p"]), [], 2.5), ("procedural", "strange", line(skill_name="k"), None, None), ("semantic", "fact", line(schema=1, subject="hidden"), None, None)]), now())
    assert {r.tier: r.entries for r in log.counts().collect()} == {"episodic": 250, "semantic": 1, "procedural": 1}
    assert log.search("event", now(), limit=100).count() == 100
    assert log.search("hidden", now()).count() == 0
    own = json.loads(log.search('"own"', now()).first().entry)
    assert (own["id"], own["weight"], own["tags"], own["_tier"], own["_type"]) == ("own", 2.5, ["p"], "semantic", "fact")
    assert log.entries().filter("e_type = 'strange'").first().file == "skills"
    assert log.search("é", now(), limit=5).count() == 5
    events = spark.createDataFrame([("semantic", "own", 0.9, 1), ("semantic", "none", 0.9, 2)], "tier string, id string, task_score double, seq long")
    assert [(r.id, r.weight) for r in log.adjust(events).collect()] == [("own", 2.75)]
    done = log.compact(f"file://{tmp_path}/compact")
    assert done.entries().filter("id = 'own'").first().weight == 2.75
    assert log.health().first().total == 252
    with pytest.raises(Exception, match="unknown tier"):
        log.append(payloads(spark, [("working", "x", "{}", None, None)]), now())
    with pytest.raises(ValueError):
        log.adjust(spark.createDataFrame([("semantic", "own", 1.5, 1)], "tier string, id string, task_score double, seq long"))


def test_files_keep_physical_line_numbers(spark, tmp_path):
    d = tmp_path / "m/episodic"
    d.mkdir(parents=True)
    (d / "experiences.jsonl").write_text('not-json\n{"schema": "header"}\n\n' + line(id="1", title="valid   line") + "\n")
    e = jsonl.parse(jsonl.read_files(spark, f"file://{tmp_path}/m", ["episodic"]))
    assert [(r.line_no, r.tier, r.file, r.id) for r in e.collect()] == [(4, "episodic", "experiences", "1")]
    log = MemoryLog(spark, f"file://{tmp_path}/log")
    log.import_files(f"file://{tmp_path}/m")
    assert log.total() == 1


def test_routing_and_detection(spark):
    df = spark.createDataFrame([("episodic", "failure"), ("semantic", "odd"), ("working", "fact")], "t string, k string")
    assert [r[0] for r in df.select(E.route(F.col("t"), F.col("k"))).collect()] == ["failures", "facts", None]
    keys = spark.createDataFrame([("episodic", ["type"]), ("semantic", ["type"]), ("procedural", ["skill_name", "x"])], "t string, k array<string>")
    assert [r[0] for r in keys.select(E.detect_type(F.col("t"), F.col("k"))).collect()] == ["experience", "unknown", "skill"]


def test_browse(spark):
    p = spark.createDataFrame([("a/b/c.md",), ("a/d.md",), ("/e.md",)], "path string")
    assert corpus.browse(p).first()[1:] == (True, ["a"], ["e.md"])
    assert corpus.browse(p, "a").first()[1:] == (True, ["b"], ["d.md"])
    assert corpus.browse(p, "zz").first().exists is False
    with pytest.raises(ValueError):
        corpus.browse(p, "../x")


def test_stream_equals_batch_and_reads_each_file_once(spark, tmp_path):
    from engramlake.streaming.append import append_stream, streamed

    root = f"file://{tmp_path}"
    put = lambda rows: spark.createDataFrame(rows, "value string, tier string, file string").write.mode("append").partitionBy("tier", "file").text(f"{root}/in")
    put([(line(id="1"), "episodic", "experiences"), ("bad", "episodic", "experiences")])
    append_stream(spark, f"{root}/in", root).awaitTermination()
    put([(line(id="2"), "semantic", "facts")])
    append_stream(spark, f"{root}/in", root).awaitTermination()
    assert sorted((r.tier, r.id) for r in streamed(spark, root).select("tier", "id").collect()) == [("episodic", "1"), ("semantic", "2")]


