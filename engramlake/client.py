"""The service's calls as methods: a synchronous and an asynchronous client, and what agents call.

Answers are small dictionaries, as a caller of single requests expects; batches are better sent to
``MemoryLog`` and ``DocumentStore``, which these wrap.
"""

from __future__ import annotations

import asyncio
import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .model import BUDGET, LIMIT, TOP_K, check_tiers, within
from .operators.ingest import DocumentStore
from .operators.memory import MemoryLog
from .plans import etl
from .session import written
from .sources import corpus

#: Columns of a payload that ``MemoryLog.append`` takes.
_PAYLOAD = "tier string, type string, payload string, tags array<string>, weight double"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Client:
    """Calls on a log and a store below one folder. embed: gives the vector of a query's text, for ``smart_query``."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[str], list[float]] | None = None) -> None:
        self.spark, self.embed, self.closed = spark, embed, False
        self.log_, self.store = MemoryLog(spark, f"{root.rstrip('/')}/memory"), DocumentStore(spark, f"{root.rstrip('/')}/documents")

    def close(self) -> None:
        """Ends the client: further calls are an error. The session, which others may use, goes on."""
        self.closed = True

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def __getattribute__(self, name: str) -> object:
        if name in ("log_", "store") and object.__getattribute__(self, "__dict__").get("closed"):
            raise RuntimeError("the client is closed")
        return object.__getattribute__(self, name)

    # --- the log

    def write(self, tier: str, entry_type: str, payload: dict, tags: list[str] | None = None, weight: float | None = None) -> dict:
        """id, tier and file of the entry."""
        check_tiers([tier])
        row = self.spark.createDataFrame([(tier, entry_type, json.dumps(payload, ensure_ascii=False), tags, weight)], _PAYLOAD)
        return self.log_.append(row, F.current_timestamp()).first().asDict()

    def search(self, query: str, tier: list[str] | None = None, limit: int = LIMIT[2], date_from: str | None = None, date_to: str | None = None, min_weight: float | None = None) -> dict:
        found = self.log_.search(query, F.current_timestamp(), tiers=tier, limit=limit, date_from=date_from, date_to=date_to, min_weight=min_weight).collect()  # at most limit rows
        hits = [{"tier": r["tier"], "type": r["type"], "entry": json.loads(r["entry"]), "score": r["score"]} for r in found]
        return {"query": query, "total": len(hits), "results": hits}

    def adjust_weight(self, entry_id: str, tier: str, task_score: float) -> dict | None:
        """The changed entry (the last of several with the id); none: no such id."""
        seq = int(datetime.now(timezone.utc).timestamp() * 1e6)
        out = self.log_.adjust(self.spark.createDataFrame([(tier, entry_id, float(task_score), seq)], "tier string, id string, task_score double, seq long"))
        row = out.orderBy(F.desc("file")).first()
        return json.loads(row["entry"]) if row else None

    def browse(self, path: str = "", files: DataFrame | None = None) -> dict:
        """Directories and files below a path: of full texts, or of a frame with column path."""
        paths = self.store.documents().select(F.col("l2_file_path").alias("path")) if files is None else files
        return corpus.browse(paths, path).first().asDict()

    def health(self) -> dict:
        row = self.log_.health().first()
        return {"status": "ok", "total": row["total"], "tiers": row["tiers"]}

    # --- documents

    def ingest(self, content: str, title: str, hierarchy_path: str, doc_type: str = "reference", tags: list[str] | None = None) -> dict:
        docs = self.spark.createDataFrame([(title, hierarchy_path, doc_type, tags or [], content, self.embed(content) if self.embed else None)], "title string, hierarchy_path string, doc_type string, tags array<string>, content string, embedding array<double>")
        return self.store.ingest(docs if self.embed else docs.drop("embedding"), F.current_timestamp()).first().asDict()

    def smart_query(self, query: str, token_budget: int = BUDGET[2], directory: str | None = None, top_k: int = TOP_K[2], agent_id: str | None = None, tier: list[str] | None = None) -> dict:
        """Results by resolution, and their tokens. The log's tiers may be named, as agents do; documents are in none of them, so this leaves out nothing."""
        check_tiers(tier)
        if self.embed is None:
            raise ValueError("a query by text needs embed")
        within("token_budget", token_budget, BUDGET)
        q = self.spark.createDataFrame([(0, self.embed(query), token_budget, directory, query, agent_id)], "query_id int, embedding array<double>, token_budget int, directory string, query_text string, agent_id string")
        found = self.store.smart_query(None, q, top_k=top_k, directory=directory is not None).orderBy("rank").collect()  # at most top_k rows
        text = {"l0": "l0_abstract", "l1": "l1_overview", "l2": "l2_content"}
        hits = [{"doc_id": r["doc_id"], "title": r["title"], "tier": r["tier"], "score": r["score"], "content": r[text[r["tier"]]], "tokens": r["tokens_used"]} for r in found]
        return {"query": query, "total_tokens": sum(h["tokens"] for h in hits), "results": hits}

    def document(self, doc_id: str, tier: str = "l0") -> dict:
        """A document at a tier: its text, tokens and the tier that was there; empty without such a document or tier."""
        row = self.store.document_tier(doc_id, tier).first()
        return row.asDict() if row else {}

    # --- what agents write

    def _record(self, tier: str, entry_type: str, record: Column) -> str:
        row = self.spark.range(1).select(record.alias("r")).select("r.*")
        return self.log_.append(etl.as_entries(row, tier, entry_type), F.current_timestamp()).first()["id"]

    def log(self, entry_type: str, title: str, content: str, tags: list[str] | None = None) -> str:
        """The id of a new experience."""
        return self.write_episode(entry_type, title, content, tags)

    def write_episode(self, episode_type: str, title: str, outcome: str, tags: list[str] | None = None, **metadata: object) -> str:
        words = F.array(*map(F.lit, tags or [])).cast("array<string>")
        return self._record("episodic", "experience", etl.episode(F.lit(episode_type), F.lit(title), F.lit(outcome), words, F.lit(_now()), **{k: F.lit(v) for k, v in metadata.items()}))

    def write_fact(self, subject: str, predicate: str, object: str, confidence: float = 1.0, source: str = "daemon") -> str:
        return self._record("semantic", "fact", etl.fact(F.lit(subject), F.lit(predicate), F.lit(object), F.lit(_now()), confidence, source))

    def write_skill(self, skill_name: str, category: str, success_rate: float, when_to_use: str, avg_duration: str | None = None) -> str:
        return self._record("procedural", "skill", etl.skill(F.lit(skill_name), F.lit(category), F.lit(success_rate), F.lit(when_to_use), F.lit(_now()), None if avg_duration is None else F.lit(avg_duration)))

    def log_goal(self, goal: str, outcome: str, success: bool, duration_ms: int) -> str:
        return self._record("episodic", "experience", etl.goal_episode(F.lit(goal), F.lit(outcome), F.lit(success), F.lit(_now()), F.lit(duration_ms)))

    def log_cycle(self, phase: str, outcome: str, model: str, duration_ms: int) -> str:
        return self._record("episodic", "experience", etl.cycle_episode(F.lit(phase), F.lit(outcome), F.lit(model), F.lit(_now()), F.lit(duration_ms)))

    def search_memory(self, query: str, tier: list[str] | None = None, limit: int = 5) -> dict:
        return self.search(query, tier, limit)

    # --- loading

    def export(self, exports: dict[str, DataFrame], migrated: DataFrame, tier: str | None = None, batch_size: int = 100, limit: int = 0, dry_run: bool = False) -> tuple[dict[str, int], DataFrame]:
        """Entries written by tier (to be written, if dry_run) and the new checkpoint.

        exports: by tier the rows of ``etl.episodes``' input, of a facts table or of skills (``raw``), each
        with an id. A limit (0: none) applies before what was migrated goes; the count of a dry run
        holds rows without content too. batch_size: rows of an append's partition, in thousands.
        """
        kinds = {"episodic": ("experience", etl.episodes), "semantic": ("fact", etl.fact_payloads), "procedural": ("skill", etl.skill_payloads)}
        out = {}
        for t in check_tiers([tier] if tier else None):
            if t not in exports:
                continue
            kind, payloads = kinds[t]
            left, seen = etl.pending(exports[t].withColumn("id", F.col("id").cast("string")), migrated, t, limit or None), Observation()
            if dry_run:
                out[t] = left.count()
                continue
            # one job over the source: what it writes is what is counted, appended and checkpointed
            rows = written(payloads(left).observe(seen, F.count(F.lit(1)).alias("rows")))
            out[t] = seen.get["rows"]
            if out[t]:
                self.log_.append(etl.as_entries(rows, t, kind).repartition(max(1, -(-out[t] // (1000 * batch_size)))), F.current_timestamp())
                migrated = etl.record_ids(migrated, rows, t)
        return out, migrated

    def migrate_profile(self, docs: DataFrame) -> DataFrame:
        """Facts from Markdown profiles (``content``) are appended; what was written."""
        p = etl.profile(docs)
        pairs = F.array(*(F.struct(F.lit(k).alias("predicate"), F.array(F.col(k)).alias("objects")) for k in ("location", "timezone")), *(F.struct(F.lit(k).alias("predicate"), F.col(k).alias("objects")) for k in ("work", "projects")))
        facts = p.select(F.coalesce("name", F.lit("user")).alias("subject"), F.inline(pairs)).select("subject", "predicate", F.explode("objects").alias("object")).filter("object IS NOT NULL")
        rows = facts.select(etl.fact(F.col("subject"), F.col("predicate"), F.col("object"), F.lit(_now()), source="profile").alias("r")).select("r.*")
        return self.log_.append(etl.as_entries(rows, "semantic", "fact"), F.current_timestamp())

    def migrate_logs(self, logs: DataFrame, tag: str = "migrated") -> DataFrame:
        """Experiences from daily Markdown logs (date, content) are appended; what was written."""
        return self.log_.append(etl.as_entries(etl.log_experiences(logs, tag), "episodic", "experience"), F.current_timestamp())

    def migrate_corpus(self, files: DataFrame) -> DataFrame:
        """Markdown files (stem, title, content) are ingested as research documents; their ids and tokens."""
        return self.store.ingest(etl.research_documents(files), F.current_timestamp())


class AsyncClient:
    """The same calls as coroutines: ``await AsyncClient(client).search("text")``; several run at once."""

    def __init__(self, client: Client) -> None:
        self.client = client

    def __getattr__(self, name: str) -> Callable:
        call = getattr(self.client, name)

        async def run(*args: object, **options: object) -> object:
            return await asyncio.to_thread(call, *args, **options)

        return run

    async def __aenter__(self) -> AsyncClient:
        return self

    async def __aexit__(self, *exc: object) -> None:
        self.close()

    def close(self) -> None:
        """Ends the client; see ``Client.close``."""
        self.client.close()


#: What stands for an entry in a list: the first of these fields that says something.
TITLES = ("title", "skill_name", "subject")


def title_of(entry: dict) -> str:
    """What a list shows of an entry; an empty subject stands as it is (``expr.label`` is the same for columns)."""
    for field in TITLES:
        if entry.get(field) or (field == TITLES[-1] and field in entry):
            return entry[field]
    return "untitled"
