"""Loading other systems' memories: Markdown profiles and daily logs, exports of episodes, facts and skills, with checkpoints of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.corpus import current_facts

_S = "string"


def profile(docs: DataFrame, *more: Column) -> DataFrame:
    """name, location, timezone, work and projects from Markdown (``content``), after more columns; a section counts only if another follows it."""
    section = lambda head: F.regexp_extract("content", rf"(?s)## {head}\n(.*?)\n##", 1)
    basics, work, projects = section("Basics"), E.strip(section("Work")), E.strip(section("Projects"))
    field = lambda k: F.nullif(F.regexp_extract(basics, rf"\*\*{k}:\*\* (.+)", 1), F.lit(""))
    lines = lambda text, head: F.filter(F.split(text, "\n"), lambda x: F.startswith(x, F.lit(head)))
    return docs.select(
        *more,
        field("Name").alias("name"),
        field("Location").alias("location"),
        field("Timezone").alias("timezone"),
        F.transform(lines(work, "-"), lambda x: F.btrim(x, F.lit("- "))).alias("work"),
        F.transform(lines(projects, "- **"), lambda x: F.substring_index(F.btrim(x, F.lit("- *")), ":**", 1)).alias("projects"),
    )


def section_fields(parts: DataFrame) -> DataFrame:
    """parts (date, part and any other columns) with title and body: the first line and the rest; a section of one line goes."""
    body = F.expr("substring(part, length(substring_index(part, '\n', 1)) + 2)")
    rows = parts.filter(F.contains("part", F.lit("\n")))
    return rows.select(*(c for c in parts.columns if c != "part"), E.strip(F.substring_index("part", "\n", 1)).alias("title"), E.strip(body).alias("body"))


def sections(logs: DataFrame) -> DataFrame:
    """date, n (from 1), title and body of each second-level section of Markdown logs (date, content).

    What comes before the first one goes, and so does a section of one line.
    """
    parts = F.split("content", "\n## ", -1)
    rows = logs.select("date", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("n", "part"))
    return section_fields(rows.withColumn("n", F.col("n") + 1))


def experiences(found: DataFrame, tag: str) -> DataFrame:
    """Payload columns of sections (date, title, body): at noon of the day, the body clipped to 200 characters."""
    return found.select(F.concat("date", F.lit("T12:00:00Z")).alias("ts"), F.lit("observation").alias("type"), "title", E.clip(F.col("body"), 200).alias("outcome"), F.array(F.lit(tag), F.col("date")).alias("tags"), *(c for c in ("n",) if c in found.columns))


def log_experiences(logs: DataFrame, tag: str = "migrated") -> DataFrame:
    """Payload columns of the experiences in daily logs."""
    return experiences(sections(logs), tag)


def pending(rows: DataFrame, migrated: DataFrame, source: str, limit: int | None = None, order: str = "id") -> DataFrame:
    """Rows whose id (null: empty) isn't among a source's migrated ones. A limit applies first, so repeating it brings nothing new."""
    rows = rows.orderBy(order).limit(limit) if limit is not None else rows
    done = migrated.filter(F.col("source") == source).select(F.col("id").alias("_done")).distinct()
    return rows.join(done, F.coalesce("id", F.lit("")) == F.col("_done"), "left_anti")


def episodes(raw: DataFrame) -> DataFrame:
    """Payload columns of exported episodes: document, metadata and episode as JSON text, id.

    Metadata holds where it has a key, even null; else the episode; else the default. Rows without content go.
    """
    m, e = F.coalesce("metadata", F.lit("{}")), F.coalesce("episode", F.lit("{}"))
    of = lambda k, t=_S: F.try_variant_get(F.try_parse_json(e), f"$.{k}", t)
    content = F.coalesce(F.nullif("document", F.lit("")), of("content"), F.lit(""))
    return raw.filter(content != "").select(
        E.by_presence(m, e, "created_at", F.lit("")).alias("ts"),
        E.by_presence(m, e, "event_type", F.lit("observation")).alias("type"),
        E.headline(content).alias("title"),
        content.alias("content"),
        F.coalesce(of("outcome"), F.when(F.array_contains(F.json_object_keys(e), "outcome"), None).otherwise("")).alias("outcome"),
        E.by_presence(m, e, "source", F.lit("daemon")).alias("source"),
        E.by_presence(m, e, "importance", F.lit(0.5), "double").alias("importance"),
        F.coalesce("id", F.lit("")).alias("daemon_id"),
        F.coalesce(of("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
    )


def fact_payloads(facts: DataFrame) -> DataFrame:
    """Payload columns of the current facts of a table; without confidence or source columns these are 0.8 and daemon."""
    has = set(facts.columns)
    return current_facts(facts).select(
        (F.col("created_at") if "created_at" in has else F.lit("")).alias("ts"),
        "subject",
        "predicate",
        "object",
        (F.col("confidence") if "confidence" in has else F.lit(0.8)).alias("confidence"),
        (F.col("source") if "source" in has else F.lit("daemon")).alias("source"),
        F.col("id").alias("daemon_id"),
        F.array().cast("array<string>").alias("tags"),
    )


def skill_payloads(raw: DataFrame) -> DataFrame:
    """Payload columns of exported skills (``raw``, one JSON object a row)."""
    get = lambda k, default, t=_S: E.by_presence(F.col("raw"), F.lit("{}"), k, default, t)
    return raw.select(
        get("created_at", F.lit("")).alias("ts"),
        get("name", F.lit("unknown")).alias("skill_name"),
        get("description", F.lit("")).alias("description"),
        F.lit("daemon").alias("category"),
        get("trigger", F.lit("")).alias("when_to_use"),
        get("procedure", F.lit("")).alias("procedure"),
        get("success_rate", F.lit(0.0), "double").alias("success_rate"),
        get("id", F.lit("")).alias("daemon_id"),
        get("tags", F.array().cast("array<string>"), "array<string>").alias("tags"),
    )


def as_entries(payloads: DataFrame, tier: str, entry_type: str, drop: tuple[str, ...] = ("n",)) -> DataFrame:
    """Rows to append, for ``MemoryLog.append``: tier, type, payload (all columns as JSON, nulls kept), tags, weight."""
    columns = [c for c in payloads.columns if c not in drop]
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    tags = F.col("tags") if "tags" in columns else F.lit(None).cast("array<string>")
    return payloads.select(F.lit(tier).alias("tier"), F.lit(entry_type).alias("type"), body.alias("payload"), tags.alias("tags"), F.lit(None).cast("double").alias("weight"))


def record_ids(migrated: DataFrame, payloads: DataFrame, source: str) -> DataFrame:
    """The checkpoint with the ids of these payloads added."""
    return migrated.union(payloads.select(F.lit(source).alias("source"), F.coalesce("daemon_id", F.lit("")).alias("id"))).distinct()


def research_documents(files: DataFrame) -> DataFrame:
    """Documents to ingest from Markdown files (stem, title, content)."""
    return files.select("title", "content", F.concat(F.lit("/research/"), "stem").alias("hierarchy_path"), F.lit("research").alias("doc_type"), F.array(F.lit("research"), F.lit("migrated")).alias("tags"))


# --- records that agents write


def episode(kind: Column, title: Column, outcome: Column, tags: Column, ts: Column, **metadata: Column) -> Column:
    """The payload of an experience; metadata keys follow the others."""
    return F.struct(ts.alias("ts"), kind.alias("type"), title.alias("title"), outcome.alias("outcome"), tags.alias("tags"), *(v.alias(k) for k, v in metadata.items()))


def goal_episode(goal: Column, outcome: Column, success: Column, ts: Column, duration_ms: Column | None = None) -> Column:
    more = {} if duration_ms is None else {"duration_ms": duration_ms}
    return episode(F.when(success, "achievement").otherwise("failure"), F.concat(F.lit("Goal: "), goal), outcome, F.array(F.lit("goal"), F.lit("execution"), F.when(success, "success").otherwise("failure")), ts, **more)


def cycle_episode(phase: Column, outcome: Column, model: Column, ts: Column, duration_ms: Column | None = None) -> Column:
    more = {} if duration_ms is None else {"duration_ms": duration_ms}
    return episode(F.lit("consciousness_cycle"), F.concat(F.lit("Consciousness: "), phase), outcome, F.array(F.lit("consciousness"), F.lower(phase), model), ts, model=model, **more)


def fact(subject: Column, predicate: Column, obj: Column, ts: Column, confidence: float = 1.0, source: str = "daemon") -> Column:
    return F.struct(ts.alias("ts"), subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.array().cast("array<string>").alias("tags"))


def skill(name: Column, category: Column, success_rate: Column, when_to_use: Column, ts: Column, avg_duration: Column | None = None) -> Column:
    more = [] if avg_duration is None else [avg_duration.alias("avg_duration")]
    return F.struct(ts.alias("ts"), name.alias("skill_name"), category.alias("category"), success_rate.alias("success_rate"), when_to_use.alias("when_to_use"), F.array().cast("array<string>").alias("tags"), *more)
