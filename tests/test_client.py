"""Clients, the command line, concurrent appends and the stored line after an outcome."""

import asyncio
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from engramlake.__main__ import main
from engramlake.client import AsyncClient, Client
from engramlake.operators.memory import MemoryLog
from engramlake.sources import jsonl


@pytest.fixture
def client(spark, tmp_path):
    return Client(spark, f"file://{tmp_path}", embed=lambda text: [float(text.count("a")), float(text.count("b")) + 0.1])


def test_appends_at_once_have_their_own_line_numbers(spark, tmp_path):
    log = MemoryLog(spark, f"file://{tmp_path}")

    def write(k):
        rows = [("episodic", "experience", json.dumps({"id": f"c{k}-{i}", "title": f"concurrent-{k}"}), None, None) for i in range(8)]
        out = MemoryLog(spark, f"file://{tmp_path}").append(spark.createDataFrame(rows, "tier string, type string, payload string, tags array<string>, weight double"), F.current_timestamp())
        return {r.id for r in out.collect()}

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(write, range(6)))
    assert got == [{f"c{k}-{i}" for i in range(8)} for k in range(6)]
    e = log.entries()
    assert e.count() == 48 == e.select("append", "line_no").distinct().count() and log.total() == 48


def test_an_outcome_is_seen_in_the_entry_and_moves_no_texts(spark, tmp_path):
    log = MemoryLog(spark, f"file://{tmp_path}")
    rows = [("semantic", "fact", json.dumps({"id": f"f{i}", "subject": f"s{i} ünï"}, ensure_ascii=False), ["t"], None) for i in range(30)]
    log.append(spark.createDataFrame(rows, "tier string, type string, payload string, tags array<string>, weight double"), F.current_timestamp())
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    out = log.adjust(spark.createDataFrame([("semantic", "f3", 0.9, 1), ("semantic", "no", 0.9, 1)], "tier string, id string, task_score double, seq long"), now).collect()
    assert [(r.id, r.weight) for r in out] == [("f3", 1.1)]
    hit = log.search("s3 weight_updated", F.current_timestamp()).first()
    entry = json.loads(hit.entry)
    assert entry["weight"] == 1.1 and entry["_weight_updated_at"] == "2026-01-02T03:04:05.000000+00:00" and entry["subject"] == "s3 ünï"
    assert list(entry)[-1] == "_weight_updated_at" and '"weight": 1.1' in hit.entry
    plan = log.search("s3", F.current_timestamp())._jdf.queryExecution().toString()
    scan = [x for x in plan.split("== Physical Plan ==")[1].splitlines() if "Exchange" in x]
    assert scan and all("BroadcastExchange" in x for x in scan)
    done = log.compact(f"file://{tmp_path}/again")
    assert done.entries().filter("weight = 1.1").count() == 1 and done.total() == 30
    done.append(spark.createDataFrame(rows[:2], "tier string, type string, payload string, tags array<string>, weight double"), F.current_timestamp())
    assert done.entries().select("append", "line_no").distinct().count() == 32


def test_lines_are_numbered_across_splits(spark, tmp_path):
    folder = tmp_path / "episodic"
    folder.mkdir()
    lines = ["not-json", '{"schema": "header"}', "", *(json.dumps({"id": str(i), "title": "t " + "x" * (i % 50)}, ensure_ascii=False) for i in range(4000))]
    (folder / "experiences.jsonl").write_text("\n".join(lines) + "\n")
    (folder / "failures.jsonl").write_text('{"id": "a"}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = jsonl.read_files(spark, f"file://{tmp_path}", ["episodic"])
        got = {(r.file, r.id): r.line_no for r in jsonl.parse(read).collect()}
        assert read.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("experiences", str(i)): i + 4 for i in range(4000)} | {("failures", "a"): 1}


def test_calls_of_a_client(client, capsys):
    i = client.log("note", "First thing", "went well", ["x"])
    client.write_fact("sky", "is", "blue")
    client.write_skill("dig", "garden", 0.5, "soil", avg_duration="1h")
    client.log_goal("reach b", "done", True, 12)
    client.log_cycle("Plan", "thought", "m1", 5)
    assert client.health()["tiers"] == {"episodic": 3, "semantic": 1, "procedural": 1}
    hit = client.search("first thing", ["episodic"])["results"][0]
    assert hit["entry"]["id"] == i and hit["entry"]["tags"] == ["x"] and hit["score"] > 0
    goal = client.search("goal: reach")["results"][0]["entry"]
    assert goal["duration_ms"] == 12 and goal["type"] == "achievement"
    assert client.search_memory("dig")["results"][0]["entry"]["avg_duration"] == "1h"
    assert client.adjust_weight(i, "episodic", 0.95)["weight"] == pytest.approx(0.8 * 1.1) or client.search("first thing")["results"][0]["entry"]["weight"] == 1.1
    assert client.adjust_weight("none", "episodic", 0.5) is None
    with pytest.raises(ValueError, match="unknown tier"):
        client.write("odd", "fact", {})
    assert main(["status"], client)[1].startswith("entries: 5") and main(["search", "sky", "--tier", "semantic"], client)[1].endswith("sky")


def test_documents_of_a_client(client):
    client.ingest("a" * 3000, "Much of a", "/x")
    client.ingest("b" * 80, "B only", "/y")
    out = client.smart_query("aaa", token_budget=5000, top_k=2)
    assert [r["title"] for r in out["results"]] == ["Much of a", "B only"] and out["results"][0]["tier"] == "l2"
    assert [r["title"] for r in client.smart_query("aaa", directory="/y")["results"]] == ["B only"]
    assert client.browse()["directories"] == ["x", "y"] and client.browse("x")["files"] == ["Much_of_a.md"]


def test_coroutines_run_at_once(client):
    async def run():
        async with AsyncClient(client) as c:
            await asyncio.gather(*(c.write("semantic", "fact", {"id": f"k{i}", "subject": f"evt-{i}"}) for i in range(4)))
            return await c.search("evt-2")

    assert asyncio.run(run())["total"] == 1


def test_export_options(client, spark):
    facts = spark.createDataFrame([(str(i), "s", "p", f"o{i}", None, None) for i in range(6)], "id string, subject string, predicate string, object string, valid_to string, invalidated_at string")
    episodes = spark.createDataFrame([("e1", "doc", "{}", "{}"), ("e2", "", "{}", "{}")], "id string, document string, metadata string, episode string")
    none = spark.createDataFrame([], "source string, id string")
    exports = {"semantic": facts, "episodic": episodes}
    assert client.export(exports, none, dry_run=True)[0] == {"episodic": 2, "semantic": 6} and client.health()["total"] in (0, None)
    counts, done = client.export(exports, none, limit=4)
    assert counts == {"episodic": 1, "semantic": 4}
    assert client.export(exports, done, tier="semantic", batch_size=1)[0] == {"semantic": 2}
    assert client.health()["tiers"]["semantic"] == 6


def test_migrations(client, spark):
    client.migrate_profile(spark.createDataFrame([("## Basics\n- **Name:** Ann\n- **Timezone:** UTC\n\n## Work\n- one\n- two\n\n## Projects\n- **P:** x\n\n## End\n",)], "content string"))
    client.migrate_logs(spark.createDataFrame([("2026-02-26", "# D\n\n## First\nDid\n")], "date string, content string"))
    client.migrate_corpus(spark.createDataFrame([("one-two", "One Two", "# One\nText.")], "stem string, title string, content string"))
    assert client.health()["tiers"] == {"episodic": 1, "semantic": 4, "procedural": 0}
    assert client.store.documents().first().l1_overview == "# One Two\n\n## One\nText."
