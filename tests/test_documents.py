import random

import pytest
from pyspark.sql import functions as F

from engramlake.functions import expr as E
from engramlake.operators import disclosure as D
from engramlake.operators import ingest
from engramlake.operators.ingest import DocumentStore
from engramlake.plans import etl
from engramlake.sources import corpus

DOC = "doc_id string, title string, hierarchy_path string, l0_abstract string, l0_tokens int, l1_overview string, l1_tokens int, l2_file_path string, l2_tokens int"


def fixture(spark):
    docs = spark.createDataFrame([("doc-1", "Doc 1", "/research", "quick summary", 50, "expanded overview", 200, "one", 700), ("doc-2", "Doc 2", "/research", "other summary", 40, "other overview", 180, "two", 800)], DOC)
    texts = spark.createDataFrame([("one", "full text")], "l2_file_path string, content string")
    hits = spark.createDataFrame([(1, "doc-1", 0.9, 1), (1, "doc-2", 0.45, 2)], "query_id int, doc_id string, score double, rank int")
    return docs, texts, hits


def test_escalation_within_a_budget(spark):
    docs, texts, hits = fixture(spark)
    rows = D.retrieve_l0(hits, docs).withColumn("l2_exists", F.col("l2_file_path") == "one")
    got = [(r.doc_id, r.tier, r.tokens_used) for r in D.escalate(rows, F.lit(1200)).orderBy("rank").collect()]
    assert got == [("doc-1", "l2", 700), ("doc-2", "l0", 40)]
    got = [(r.doc_id, r.tier, r.tokens_used) for r in D.escalate(rows, F.lit(4000)).orderBy("rank").collect()]
    assert got == [("doc-1", "l2", 700), ("doc-2", "l1", 180)]


def test_full_text_falls_back(spark):
    docs, texts, _ = fixture(spark)
    got = {r.doc_id: tuple(r)[1:] for r in D.document_tier(docs, texts, F.lit("l2")).collect()}
    assert got == {"doc-1": ("l2", "full text", 700, False), "doc-2": ("l1", "other overview", 180, True)}
    assert D.document_tier(docs, texts, F.lit("l9")).count() == 0


def test_min_score_and_dangling_hits(spark):
    docs, _, _ = fixture(spark)
    hits = spark.createDataFrame([(1, "doc-1", 0.8, 1), (1, "missing", 0.9, 2), (1, "doc-2", 0.1, 3)], "query_id int, doc_id string, score double, rank int")
    assert [(r.doc_id, r.rank) for r in D.retrieve_l0(hits, docs, 0.3).collect()] == [("doc-1", 1)]


def test_expand_and_load_by_index(spark):
    docs, texts, hits = fixture(spark)
    rows = D.expand_l1(D.retrieve_l0(hits, docs), indices=[0, 9])
    assert [(r.tier, r.tokens_used) for r in rows.orderBy("rank").collect()] == [("l1", 200), ("l0", 40)]
    full = D.load_l2(rows, texts, [0, 1, 7]).orderBy("rank").collect()
    assert [(r.tier, r.tokens_used, r.l2_content) for r in full] == [("l2", 700, "full text"), ("l0", 40, None)]


def procedural(rows, budget):
    """The escalation, one decision after another."""
    tier = ["l0"] * len(rows)
    used = sum(r["l0"] for r in rows)
    eligible = [i for i, r in enumerate(rows) if r["score"] >= 0.4]
    chosen = []
    for i in eligible:
        if used + 2000 <= budget:
            chosen.append(i)
        if len(chosen) >= 3:
            break
    for i in chosen:
        if rows[i]["has"]:
            tier[i] = "l1"
    now = sum(r["l1"] if t == "l1" else r["l0"] for r, t in zip(rows, tier))
    for i, r in enumerate(rows):
        if r["score"] >= 0.7 and now + r["l2"] <= budget:
            if r["file"]:
                tier[i] = "l2"
            break
    return tier


def test_closed_form_equals_procedure(spark):
    r = random.Random(11)
    rows, want = [], {}
    for q in range(150):
        n, budget = r.randrange(1, 9), r.choice([300, 1500, 2500, 4000, 9000])
        scores = sorted((r.choice([0.2, 0.4, 0.5, 0.7, 0.8, 0.95]) for _ in range(n)), reverse=True)
        docs = [{"score": s, "l0": r.randrange(20, 400), "l1": r.randrange(100, 1500), "l2": r.randrange(200, 6000), "has": r.random() < 0.8, "file": r.random() < 0.8} for s in scores]
        want[q] = procedural(docs, budget)
        rows += [(q, i + 1, d["score"], d["l0"], d["l1"], d["l2"], "text" if d["has"] else "", d["file"], budget) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "query_id int, rank int, score double, l0_tokens int, l1_tokens int, l2_tokens int, l1_overview string, l2_exists boolean, budget int")
    got = {}
    for x in D.escalate(df, F.col("budget")).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.tier)
    assert got == want


def test_nearest_is_exact_and_filters_first(spark):
    r = random.Random(3)
    vec = [(i, [r.gauss(0, 1) for _ in range(8)], "/a" if i % 2 else "/b") for i in range(80)]
    v = D.with_norms(spark.createDataFrame(vec, "doc_id int, embedding array<float>, hierarchy_path string"))
    q = spark.createDataFrame([(k, vec[k][1], "/a" if k else None) for k in range(3)], "query_id int, embedding array<float>, directory string")
    got = {}
    for x in D.nearest(v, q, 5, directory=True).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.doc_id)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    for k in range(3):
        pool = [d for d in vec if not k or d[2] == "/a"]
        assert got[k] == [d[0] for d in sorted(pool, key=lambda d: -round(max(0, cos(d[1], vec[k][1])), 6))[:5]]


def test_store(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}")
    docs = spark.createDataFrame([("a", "First paper: α/β", "/research/x/", "reference", ["t"], "text " * 400), ("b", "Second", "/", "research", [], "short")], "doc_id string, title string, hierarchy_path string, doc_type string, tags array<string>, content string")
    assert {r.doc_id: (r.l1_tokens, r.l2_tokens) for r in store.ingest(docs).collect()} == {"a": (504, 500), "b": (3, 1)}
    d = store.document("a").first()
    assert (d.parent_path, d.depth, d.l2_file_path) == ("/research", 1, "research/x/First_paper__α_β.md")
    assert d.l0_abstract == "First paper: α/β: " + ("text " * 400).strip()[:300]
    assert [r.doc_id for r in store.list_documents().collect()] == ["b", "a"]
    again = docs.filter("doc_id = 'a'").withColumn("content", F.lit("new text"))
    store.ingest(again.withColumn("doc_id", F.lit("c")))  # shares a's full text
    assert store.mark_stale() == 1 and store.document("a").first().is_stale
    assert store.regenerate(["a"]) == 1 and not store.document("a").first().is_stale
    assert store.document_tier("a", "l2").first().content == "new text"
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("zz", [1.0, 0.1])], "doc_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 4000, "q", "me"), (2, [1.0, 1.0], 100, "r", "me")], "query_id int, embedding array<float>, token_budget int, query_text string, agent_id string")
    out = store.smart_query(vectors, q)
    assert out.filter("query_id = 1 AND rank = 1").first().doc_id == "a"
    assert sorted((int(r.query_id), r.step, r.agent_id) for r in store.query_log().collect()) == [(1, 1, None), (1, 2, "me"), (2, 1, None), (2, 2, "me")]
    with pytest.raises(Exception, match="unknown doc_type"):
        store.ingest(docs.withColumn("doc_type", F.lit("odd")))


def test_tables_are_made_once(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}").create().create()
    assert store.documents().count() == store.contents().count() == store.vectors().count() == store.query_log().count() == 0
    assert len(list((tmp_path / "documents").glob("append=*"))) == 1 and [f.name for f in store.query_log().schema][:2] == ["query_id", "step"]


def test_overviews(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(E.extract(F.lit("T"), F.col("t"))).first()[0]
    assert one("") == "# T" and one("One. Two! Three? Four.") == "# T\n\nOne. Two! Three?"
    assert one("Intro.\n# A\nx. y. z. w.\n\n## B\n## C\ntext") == "# T\n\nIntro.\n\n## A\nx. y. z.\n\n## B\n\n## C\ntext"


def test_text_rules(spark):
    one = lambda c, text: spark.createDataFrame([(text,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(E.title_case, "a_b c-d") == "A B C D"
    assert one(E.unthink, " <think>a\nb</think> x ") == "x"
    assert one(E.parent_path, "/") == "/" and one(E.parent_path, "/a/b/") == "/a" and one(E.parent_path, "a") == "/"
    assert one(E.depth, "/a/b/c/") == 2
    assert one(lambda c: E.clip(c, 200), "x" * 200) == "x" * 200 and one(lambda c: E.clip(c, 200), "x" * 201).endswith("x...")
    assert one(E.tags_list, '["a"]') == ["a"] and one(E.tags_list, "no") == []
    assert one(E.tokens, "x" * 43587) == 10896
    assert one(lambda c: E.label(c, F.lit(""), F.lit(None)), "") == "untitled"


def test_sections(spark):
    logs = spark.createDataFrame([("2026-02-26", "# Daily\n\n## First\nDid one thing\n\n## Second\nDid another thing"), ("2026-02-27", "## Start\nx\n## One line"), ("2026-02-28", "")], "date string, content string")
    got = [(r.ts, r.title, r.outcome, r.tags) for r in etl.log_experiences(logs).orderBy("ts", "n").collect()]
    assert got == [("2026-02-26T12:00:00Z", "First", "Did one thing", ["migrated", "2026-02-26"]), ("2026-02-26T12:00:00Z", "Second", "Did another thing", ["migrated", "2026-02-26"])]


def test_episodes_take_keys_by_presence(spark):
    raw = spark.createDataFrame(
        [("1", "doc", '{"source": null}', '{"source": "e", "importance": 0.9, "tags": ["a"]}'), ("2", "", "{}", '{"content": "c\\nd"}'), (None, "x", None, None), ("4", "", "{}", "{}")], "id string, document string, metadata string, episode string"
    )
    got = {r.daemon_id: (r.content, r.title, r.source, r.importance, r.tags) for r in etl.episodes(raw).collect()}
    assert got == {"1": ("doc", "doc", None, 0.9, ["a"]), "2": ("c\nd", "c d", "daemon", 0.5, []), "": ("x", "x", "daemon", 0.5, [])}


def test_pending_limits_before_the_anti_join(spark):
    rows = spark.createDataFrame([(str(i),) for i in range(5)] + [(None,)], "id string")
    none = spark.createDataFrame([], "source string, id string")
    assert etl.pending(rows, none, "s").count() == 6
    done = spark.createDataFrame([("s", "0"), ("s", "1"), ("t", "2"), ("s", "")], "source string, id string")
    assert sorted(r.id for r in etl.pending(rows, done, "s").collect()) == ["2", "3", "4"]
    assert etl.pending(rows.dropna(), done, "s", limit=2).count() == 0
    assert etl.record_ids(done, spark.createDataFrame([("9",)], "daemon_id string"), "s").count() == 5


def test_facts_skills_and_files(spark, tmp_path):
    facts = spark.createDataFrame([("1", "s", "p", "o", None, None), ("2", "s", "p", "o", "x", None)], "id string, subject string, predicate string, object string, valid_to string, invalidated_at string")
    got = etl.fact_payloads(facts).collect()
    assert [(r.daemon_id, r.confidence, r.source) for r in got] == [("1", 0.8, "daemon")]
    (tmp_path / "skills.json").write_text('[{"id": "k", "name": "n", "trigger": "t", "success_rate": 0.5, "tags": ["a"]}, {}]')
    skills = etl.skill_payloads(corpus.json_export(spark, f"file://{tmp_path}/skills.json")).collect()
    assert [(r.skill_name, r.when_to_use, r.success_rate, r.tags) for r in skills] == [("n", "t", 0.5, ["a"]), ("unknown", "", 0.0, [])]
    rows = etl.as_entries(etl.fact_payloads(facts), "semantic", "fact").first()
    assert rows.tier == "semantic" and '"subject":"s"' in rows.payload
    (tmp_path / "md").mkdir()
    (tmp_path / "md/big-idea_two.md").write_text("text")
    (tmp_path / "md/2026-02-26.md").write_text("log")
    assert etl.research_documents(corpus.markdown(spark, f"file://{tmp_path}/md", "big*.md")).first()[:3] == ("Big Idea Two", "text", "/research/big-idea_two")
    assert [r.date for r in corpus.dated_logs(spark, f"file://{tmp_path}/md").collect()] == ["2026-02-26"]


def test_profile_and_records(spark):
    d = spark.createDataFrame([("## Basics\n- **Name:** A B\n\n## Work\n- one\nno\n- two\n\n## Projects\n- **P:** x\n",)], "content string")
    r = etl.profile(d).first()
    assert (r.name, r.location, r.work, r.projects) == ("A B", None, ["one", "two"], [])  # the last section isn't followed by another
    g = spark.range(1).select(etl.goal_episode(F.lit("g"), F.lit("o"), F.lit(False), F.lit("t")).alias("g"), etl.cycle_episode(F.lit("Plan"), F.lit("o"), F.lit("m"), F.lit("t")).alias("c")).first()
    assert (g.g.type, g.g.title, g.g.tags) == ("failure", "Goal: g", ["goal", "execution", "failure"])
    assert g.c.tags == ["consciousness", "plan", "m"]


def test_summaries_and_totals(spark):
    rows = spark.createDataFrame([("a", 10, 100, 1000), ("b", 20, 50, 3000)], "doc_id string, l0_token_count int, l1_token_count int, l2_token_count int")
    t = ingest.corpus_totals(rows).first()
    assert (t.l0_total, t.l2_total, t.l0_percent, t.reduction_percent) == (30, 4000, 0.75, 99.25)


def test_an_overview_cut_at_a_space_keeps_it(spark):
    text = "word " * 2600 + "<think>a</think>"
    rows = [("T", text, "/a", "reference", [], "1"), ("T", "One <think>b</think> two.", "/a", "reference", [], "2")]
    docs = spark.createDataFrame(rows, "title string, content string, hierarchy_path string, doc_type string, tags array<string>, doc_id string")
    got = {r.doc_id: r for r in ingest.document_columns(docs).collect()}
    want = f"# T\n\n{text}"[:12000]
    assert got["1"].l1_overview == want and got["1"].l1_token_count == 3000
    assert got["2"].l1_overview == "# T\n\nOne <think>b</think> two."
