"""The queries of the reference's operators over the driver's tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import expr as E
from .model import DECAY, INITIAL_WEIGHTS
from .operators import disclosure, ingest, memory
from .operators.hierarchy import Hierarchy, directories
from .operators.shelves import Shelves
from .operators.trigrams import TrigramIndex
from .operators.vectors import VectorIndex
from .plans import etl
from .session import scratch
from .sources import corpus, jsonl
from .streaming.append import append_stream, streamed
from .streaming.weights import weights_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_NOW = "TIMESTAMPTZ '2024-02-15 00:00:00+00'"
_WEIGHT = "CASE e_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in INITIAL_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
_FILE = "CASE e_type WHEN 'experience' THEN 'experiences' WHEN 'decision' THEN 'decisions' WHEN 'failure' THEN 'failures' WHEN 'fact' THEN 'facts' WHEN 'relation' THEN 'relations' WHEN 'skill' THEN 'skills' WHEN 'pattern' THEN 'patterns' END"
_ENTRIES = f"""
ev AS (
  SELECT *, CASE WHEN event_id % 97 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || (CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END) END AS t,
    CASE event_type WHEN 'error' THEN 'episodic' WHEN 'purchase' THEN 'episodic' WHEN 'view' THEN 'episodic' WHEN 'signup' THEN 'semantic' WHEN 'click' THEN 'procedural' END AS tier,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'decision' WHEN 'view' THEN 'experience' WHEN 'signup' THEN 'fact' WHEN 'click' THEN 'skill' END AS e_type
  FROM events
), entries AS (
  SELECT event_id, user_id, tier, e_type, t AS ts, 'evt-' || event_id AS id, event_id AS line_no, {_WEIGHT} AS weight, {_FILE} AS file,
    '{{"id": "evt-' || event_id || '", ' || (CASE WHEN t IS NOT NULL THEN '"ts": "' || t || '", ' ELSE '' END) || '"title": "' || event_type || ' by user ' || user_id || '", "props": ' || props
    || ', "tags": [], "weight": ' || ({_WEIGHT})::VARCHAR || ', "_tier": "' || tier || '", "_type": "' || e_type || '"}}' AS raw
  FROM ev
), aged AS (
  SELECT *, CASE WHEN ts LIKE '%Z' THEN pow({DECAY}::DOUBLE, greatest(0, floor((epoch_us({_NOW}) - epoch_us((replace(ts, 'Z', '+00:00'))::TIMESTAMPTZ)) / 86400e6))) ELSE 1.0::DOUBLE END AS recency FROM entries
)"""


def _round(x: str, n: int = 4) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def _hits(terms: list[str]) -> str:
    return " + ".join(f"(CASE WHEN contains(lower(raw), '{t}') THEN 1 ELSE 0 END)" for t in terms)


_ORD = "CASE tier WHEN 'episodic' THEN 0 WHEN 'semantic' THEN 1 ELSE 2 END, CASE file WHEN 'experiences' THEN 0 WHEN 'decisions' THEN 1 WHEN 'failures' THEN 2 WHEN 'facts' THEN 3 WHEN 'relations' THEN 4 WHEN 'skills' THEN 5 ELSE 6 END, line_no"


def query(sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- the memory log


@query(f"WITH {_ENTRIES} SELECT t.tier, coalesce(n, 0)::BIGINT AS entries FROM (VALUES ('episodic'), ('semantic'), ('procedural')) t(tier) LEFT JOIN (SELECT tier, count(*) AS n FROM entries WHERE event_type_ok GROUP BY tier) USING (tier)".replace("WHERE event_type_ok ", "WHERE tier <> 'procedural' "))
def k1_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries scanned from lines, counted by tier; here the procedural lines are headers, which don't count."""
    e = A.event_entries(spark, sf_dir)
    line = F.when(F.col("tier") == "procedural", F.concat(F.lit('{"schema": null, '), F.substr("raw", F.lit(2)))).otherwise(F.col("raw"))
    return memory.counts(jsonl.parse(e.select("tier", "file", "line_no", line.alias("line"))))


_SEARCH = "purchase user 17 purchase"


@query(f"""WITH {_ENTRIES}, s AS (SELECT *, ({_hits(_SEARCH.split())}) / {float(len(_SEARCH.split()))}::DOUBLE * weight * recency AS u FROM aged)
SELECT tier, e_type AS type, raw AS entry, {_round('u')} AS score, line_no FROM s WHERE u > 0 ORDER BY u DESC, {_ORD} LIMIT 50""")
def k1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.search(A.event_entries(spark, sf_dir), _SEARCH, A.now(), limit=50)


@query(f"""WITH {_ENTRIES}, s AS (SELECT *, ({_hits(['user', 'click'])}) / 2.0::DOUBLE * weight * recency AS u FROM aged
WHERE tier IN ('procedural', 'episodic') AND ts >= '2024-01-05' AND (ts IS NULL OR ts <= '2024-01-20') AND weight >= 1.1)
SELECT tier, e_type AS type, raw AS entry, {_round('u')} AS score, line_no FROM s WHERE u > 0
ORDER BY u DESC, CASE tier WHEN 'procedural' THEN 0 ELSE 1 END, CASE file WHEN 'experiences' THEN 0 WHEN 'decisions' THEN 1 WHEN 'failures' THEN 2 ELSE 5 END, line_no LIMIT 100""")
def k1_search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.search(A.event_entries(spark, sf_dir), "user click", A.now(), ["procedural", "episodic"], 100, "2024-01-05", "2024-01-20", 1.1)


@query(f"""WITH {_ENTRIES}, q AS (SELECT vec_id AS query_id, CASE vec_id // 100 % 4 WHEN 0 THEN 'click by user ' || vec_id // 100 WHEN 1 THEN 'signup fact' WHEN 2 THEN 'error error failure' ELSE '"k": ' || vec_id // 100 END AS query FROM embeddings WHERE vec_id % 100 = 0),
t AS (SELECT query_id, list_filter(string_split(lower(query), ' '), lambda x: x <> '') AS terms FROM q),
s AS (SELECT query_id, aged.*, len(list_filter(terms, lambda x: contains(lower(raw), x))) / len(terms)::DOUBLE * weight * recency AS u FROM aged, t WHERE len(list_filter(terms, lambda x: contains(lower(raw), x))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY u DESC, {_ORD}) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, tier, e_type AS type, raw AS entry, {_round('u')} AS score, line_no FROM r WHERE rank <= 10""")
def k1_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 stands for a query."""
    i = F.expr("vec_id div 100")
    text = F.when(i % 4 == 0, F.concat(F.lit("click by user "), i.cast("string"))).when(i % 4 == 1, "signup fact").when(i % 4 == 2, "error error failure").otherwise(F.concat(F.lit('"k": '), i.cast("string")))
    q = A.table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), text.alias("query"))
    return memory.search_batch(A.event_entries(spark, sf_dir), q, A.now(), 10)


@query(f"""WITH {_ENTRIES}, s AS (SELECT *, ({_hits(['evt-77', 'nowhere'])}) / 2.0::DOUBLE * weight * recency AS u FROM aged)
SELECT tier, e_type AS type, raw AS entry, {_round('u')} AS score, line_no FROM s WHERE u > 0 ORDER BY u DESC, {_ORD} LIMIT 100""")
def k1_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for words of three characters or more, which reads the pages that the trigram index names."""
    index = TrigramIndex(spark, scratch(spark)).build(A.event_entries(spark, sf_dir))
    return index.search("evt-77 nowhere", A.now(), limit=100)


@query(ORACLES["k1_search_batch"])
def k1_search_batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch by the trigram index; queries with shorter words by a scan."""
    i = F.expr("vec_id div 100")
    text = F.when(i % 4 == 0, F.concat(F.lit("click by user "), i.cast("string"))).when(i % 4 == 1, "signup fact").when(i % 4 == 2, "error error failure").otherwise(F.concat(F.lit('"k": '), i.cast("string")))
    q = A.table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), text.alias("query"))
    return TrigramIndex(spark, scratch(spark)).build(A.event_entries(spark, sf_dir)).search_batch(q, A.now(), 10)


@query(ORACLES["k1_search"])
def k1_search_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over shelves of a like weight and time, read until no other can hold a result."""
    return Shelves(spark, scratch(spark)).build(A.event_entries(spark, sf_dir), shelf=2000).search(_SEARCH, A.now(), limit=50)


@query(f"WITH {_ENTRIES} SELECT id, {_round('recency', 8)} AS recency FROM aged")
def k1_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.event_entries(spark, sf_dir).select("id", E.half_up(E.recency(F.col("ts"), A.now()), 8).alias("recency"))


@query(f"WITH {_ENTRIES} SELECT id, greatest(0.1::DOUBLE, least(5.0::DOUBLE, coalesce(CASE WHEN event_id % 5 = 0 THEN event_id / 1000.0::DOUBLE END, weight))) AS weight FROM entries")
def k1_initial_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("event_id") % 5 == 0, F.col("event_id") / F.lit(1000.0))
    return A.event_entries(spark, sf_dir).select("id", E.initial_weight(given, F.col("e_type")).alias("weight"))


@query(f"""WITH {_ENTRIES} SELECT id, CASE WHEN event_id % 3 = 0 THEN (CASE tier WHEN 'episodic' THEN 'experiences' WHEN 'semantic' THEN 'facts' ELSE 'skills' END) ELSE file END AS file,
CASE WHEN tier = 'semantic' AND event_id % 2 = 0 THEN 'fact' ELSE 'unknown' END AS detected FROM entries""")
def k1_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.event_entries(spark, sf_dir)
    kind = F.when(F.col("event_id") % 3 == 0, "other").otherwise(F.col("e_type"))
    keys = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("ts"), F.lit("subject"))).otherwise(F.array(F.lit("ts")))
    return e.select("id", E.route(F.col("tier"), kind).alias("file"), E.detect_type(F.col("tier"), keys).alias("detected"))


_STEP = "(w) * (CASE WHEN s > 0.7::DOUBLE THEN 1.1::DOUBLE WHEN s < 0.3::DOUBLE THEN 0.9::DOUBLE ELSE 0.995::DOUBLE END)"
_NEW = _round(f"greatest(0.1::DOUBLE, least(5.0::DOUBLE, {_STEP}))")


@query(f"WITH {_ENTRIES} SELECT id, {_NEW} AS weight FROM (SELECT id, weight AS w, (event_id % 11) / 10.0::DOUBLE AS s FROM entries)")
def k1_reinforce_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.event_entries(spark, sf_dir).select("id", E.reinforce(F.col("weight"), F.col("event_id") % 11 / F.lit(10.0)).alias("weight"))


@query(f"""WITH {_ENTRIES}, f AS (SELECT 'evt-' || doc_id AS id, [CASE WHEN toxic = 1 THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END, CASE WHEN quality = 1 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END, (doc_id % 11) / 10.0::DOUBLE] AS scores FROM labels)
SELECT id, tier, list_reduce(list_prepend(weight, scores), lambda w, s: {_NEW}) AS weight FROM entries JOIN f USING (id)""")
def k1_reinforce_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.event_entries(spark, sf_dir)
    events = A.feedback(spark, sf_dir).join(e.select("id", "tier"), "id")
    return memory.reinforced(e, events).join(events.select("id").distinct(), "id", "left_semi").select("id", "tier", "weight")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def k1_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest(A.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_PATHS = "SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages"


@query(f"""WITH p AS ({_PATHS}), n AS (SELECT DISTINCT string_split(path, '/')[1] AS name, contains(trim(path, '/'), '/') AS d FROM p)
SELECT '' AS path, count(*) > 0 AS "exists", coalesce(list(name ORDER BY name) FILTER (WHERE d), []) AS directories, coalesce(list(name ORDER BY name) FILTER (WHERE NOT d), []) AS files FROM n""")
def k1_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.browse(A.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


_LOG = """c AS (SELECT 'c-' || c_custkey AS id, c_custkey AS k, '{"id": "c-' || c_custkey || '", "ts": "2024-01-01T00:00:00Z", "subject": "' || c_name || '", "predicate": "in", "object": "' || c_mktsegment || '", "tags": ["nation ' || c_nationkey || '"], "weight": ' AS head,
  ', "_tier": "semantic", "_type": "fact", "_written_at": "2024-02-15T00:00:00.000000+00:00"' AS tail FROM customer)"""


def _appended(spark: SparkSession, sf_dir: str) -> memory.MemoryLog:
    """A new log with a fact for each customer."""
    s = lambda c: F.col(c).cast("string")
    facts = A.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c-"), s("c_custkey")).alias("id"), F.lit("2024-01-01T00:00:00Z").alias("ts"), F.col("c_name").alias("subject"), F.lit("in").alias("predicate"), F.col("c_mktsegment").alias("object"), F.array(F.concat(F.lit("nation "), s("c_nationkey"))).alias("tags")
    )
    log = memory.MemoryLog(spark, scratch(spark))
    log.append(etl.as_entries(facts, "semantic", "fact"), A.now())
    return log


@query(f"WITH {_LOG} SELECT 'semantic' AS tier, 'facts' AS file, id, '2024-01-01T00:00:00Z' AS ts, 1.0::DOUBLE AS weight, head || '1.0' || tail || '}}' AS raw FROM c")
def k1_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as they are stored after an append."""
    return _appended(spark, sf_dir).entries().select("tier", "file", "id", "ts", "weight", "raw")


@query(f"""WITH {_LOG} SELECT id, CASE k % 3 WHEN 0 THEN 0.99::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS weight,
head || CASE k % 3 WHEN 0 THEN '0.99' WHEN 1 THEN '1.1' ELSE '1.0' END || tail || CASE k % 3 WHEN 2 THEN '}}' ELSE ', "_weight_updated_at": "2024-02-15T00:00:00.000000+00:00"}}' END AS raw FROM c""")
def k1_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after outcomes for two of three: weights and lines have changed."""
    log = _appended(spark, sf_dir)
    c = A.table(spark, sf_dir, "customer").filter("c_custkey % 3 < 2")
    scores = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.9)))
    events = c.select(F.lit("semantic").alias("tier"), F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("id"), F.posexplode(scores).alias("seq", "task_score"))
    log.adjust(events, A.now())
    return log.entries().select("id", "weight", "raw")


@query(f"WITH {_LOG} SELECT id, CASE k % 3 WHEN 0 THEN 0.891::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM c")
def k1_adjust_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that come as a stream, in two runs: the second brings an earlier one late and others again."""
    log, inbox = _appended(spark, sf_dir), scratch(spark)
    key = [F.lit("semantic").alias("tier"), F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("id")]
    c = A.table(spark, sf_dir, "customer").filter("c_custkey % 3 < 2")
    first = c.select(*key, F.lit(0.9).alias("task_score"), F.lit(5).cast("long").alias("seq"), F.lit("2024-02-15").alias("at"))
    late = c.filter("c_custkey % 3 = 0").select(*key, F.explode(F.array(F.struct(F.lit(0.1).alias("task_score"), F.lit(2).cast("long").alias("seq")), F.struct(F.lit(0.1).alias("task_score"), F.lit(9).cast("long").alias("seq")))).alias("e"), F.lit("2024-02-16").alias("at"))
    for n, events in enumerate((first, late.select("tier", "id", "e.task_score", "e.seq", "at").unionByName(first))):
        events.write.parquet(f"{inbox}/day={n}")
        weights_stream(log, f"{inbox}/day=*").awaitTermination()
    return log.entries().select("id", "weight")


@query(f"WITH {_ENTRIES} SELECT count(*)::BIGINT AS total FROM entries")
def k1_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries, as a log's health gives them."""
    log = memory.MemoryLog(spark, scratch(spark))
    log.write(A.event_entries(spark, sf_dir))
    return log.health().select("total")


@query(f"WITH {_ENTRIES} SELECT tier, file, id, (1 + row_number() OVER (PARTITION BY tier, file ORDER BY line_no))::BIGINT AS line_no FROM entries")
def k1_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical line numbers of files, each of which begins with a header."""
    root = scratch(spark)
    A.memory_files(spark, sf_dir, root)
    return jsonl.parse(jsonl.read_files(spark, f"{root}/files")).select("tier", "file", "id", "line_no")


@query(f"WITH {_ENTRIES} SELECT tier, raw AS entry FROM entries WHERE false")
def k1_search_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without words finds nothing."""
    return memory.search(A.event_entries(spark, sf_dir), "  ", A.now()).select("tier", "entry")


# --- documents at three levels

_L2P = "ltrim('/' || lang || '/' || source, '/') || '/' || regexp_replace('Doc ' || doc_id, '[^A-Za-z0-9_.-]', '_', 'g') || '.md'"
_L0 = "'Doc ' || doc_id || ': ' || substr(trim(replace(substr(text, 1, 2000), chr(10), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 300)"
_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))".format
_FIRST = lambda part: f"array_to_string(regexp_extract_all({_STRIP(part)}, '[^.!?]+(?:[.!?]+|$)')[1:3], '')"  # noqa: E731  (another route than the query's)
_PARTS = r"string_split_regex(chr(10) || text, '\n#{1,6} ')"
_EXTRACT = f"""substr({_STRIP(f"""array_to_string(list_concat(['# Doc ' || doc_id], list_filter([{_FIRST(_PARTS + '[1]')}], lambda x: x <> ''),
  list_transform({_PARTS}[2:], lambda p: {_STRIP(f"'## ' || {_STRIP('string_split(p, chr(10))[1]')} || chr(10) || {_FIRST('substr(p, length(string_split(p, chr(10))[1]) + 2)')}")})), chr(10) || chr(10))""")}, 1, 12000)"""
_L1 = f"CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_EXTRACT} END"
_DOCS = f"""
docs AS (SELECT doc_id, 'Doc ' || doc_id AS title, '/' || lang || '/' || source AS hierarchy_path, {_L0} AS l0_abstract, {_L1} AS l1_overview, length(text) // 4 AS l2_tokens, {_L2P} AS l2_file_path, text FROM documents),
lv AS (SELECT *, length(l0_abstract) // 4 AS l0_tokens, length(l1_overview) // 4 AS l1_tokens, doc_id % 7 <> 0 AS l2_exists FROM docs),
q AS (SELECT vec_id AS query_id, embedding, [1000, 4000, 20000][vec_id % 3 + 1] AS token_budget, CASE WHEN vec_id % 3 = 0 THEN '/en' END AS directory FROM embeddings WHERE vec_id % 100 = 0),
cos AS (SELECT query_id, vec_id AS doc_id, greatest(0.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS c FROM embeddings e, q)"""


def _hits_sql(k: int, stretch: float, frm: str = "cos") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, {_round(f'least(1.0::DOUBLE, c * {stretch}::DOUBLE)', 6)} AS score FROM {frm})) WHERE rank <= {k})"


@query("SELECT count(*)::BIGINT AS documents, sum(l0)::BIGINT AS l0_total, sum(l1)::BIGINT AS l1_total, sum(l2)::BIGINT AS l2_total, " + _round("100.0::DOUBLE * (sum(l0)::DOUBLE / sum(l2)::DOUBLE)").replace("100.0::DOUBLE * (sum(l0)::DOUBLE / sum(l2)::DOUBLE)", "100.0::DOUBLE * sum(l0)::DOUBLE / sum(l2)::DOUBLE") + " AS l0_percent, " + _round("100.0::DOUBLE * sum(l1)::DOUBLE / sum(l2)::DOUBLE") + " AS l1_percent, " + _round("100.0::DOUBLE * (1 - sum(l0)::DOUBLE / sum(l2)::DOUBLE)") + f" AS reduction_percent FROM (SELECT length({_L0}) // 4 AS l0, length({_L1}) // 4 AS l1, length(text) // 4 AS l2 FROM documents)")
def k2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_levels(spark, sf_dir)
    return ingest.corpus_totals(d.select(*(F.col(f"l{i}_tokens").alias(f"l{i}_token_count") for i in range(3))))


_DROP = ("created_at", "updated_at", "stale_reason", "cortex_tier", "seq", "tags", "source_type")


@query(f"""SELECT doc_id::VARCHAR AS doc_id, '/' || lang || '/' || source || '/' AS hierarchy_path, 'Doc ' || doc_id AS title, 'reference' AS doc_type, {_L0} AS l0_abstract, (length({_L0}) // 4)::INTEGER AS l0_token_count,
{_EXTRACT} AS l1_overview, (length({_EXTRACT}) // 4)::INTEGER AS l1_token_count,
{_L2P} AS l2_file_path, (length(text) // 4)::INTEGER AS l2_token_count, sha256(text) AS l2_checksum, '/' || lang AS parent_path, 1::INTEGER AS depth, false AS is_stale FROM documents""")
def k2_ingest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    docs = d.select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/")).alias("hierarchy_path"), F.lit("reference").alias("doc_type"), F.array().cast("array<string>").alias("tags"), F.col("text").alias("content"))
    return ingest.document_columns(docs).drop(*_DROP)


@query(f"WITH {_DOCS} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM {_hits_sql(10, 1.0)}")
def k2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.nearest(A.vectors(spark, sf_dir), A.vector_queries(spark, sf_dir), 10)


@query(ORACLES["k2_vector_topk"])
def k2_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index, which leaves out the lists that can't hold a result."""
    v = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return VectorIndex(spark, scratch(spark)).build(v).search(A.vector_queries(spark, sf_dir), 10, exact=True)


@query(f"WITH {_DOCS}, inside AS (SELECT cos.* FROM cos JOIN lv USING (doc_id) JOIN q USING (query_id) WHERE directory IS NULL OR starts_with(hierarchy_path, directory)) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM {_hits_sql(10, 1.0, 'inside')}")
def k2_vector_topk_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.vectors(spark, sf_dir).join(A.document_levels(spark, sf_dir).select("doc_id", "hierarchy_path"), "doc_id")
    return disclosure.nearest(v, A.vector_queries(spark, sf_dir), 10, directory=True)


@query(f"""WITH {_DOCS}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, lv.* EXCLUDE (doc_id) FROM {_hits_sql(10, 2.0)} h JOIN lv USING (doc_id) WHERE score >= 0.2)
SELECT query_id, doc_id, rank::INTEGER AS rank, CASE WHEN score >= 0.4 AND l1_overview <> '' THEN 'l1' ELSE 'l0' END AS tier, (CASE WHEN score >= 0.4 AND l1_overview <> '' THEN l1_tokens ELSE l0_tokens END)::INTEGER AS tokens_used FROM r""")
def k2_expand_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = disclosure.nearest(A.vectors(spark, sf_dir), A.vector_queries(spark, sf_dir), 10, stretch=2.0)
    return disclosure.expand_l1(disclosure.retrieve_l0(hits, A.document_levels(spark, sf_dir), 0.2)).select("query_id", "doc_id", "rank", "tier", "tokens_used")


_SMART = f"""WITH {_DOCS},
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, lv.* EXCLUDE (doc_id), token_budget FROM {_hits_sql(10, 2.0)} h JOIN lv USING (doc_id) JOIN q USING (query_id)),
a AS (SELECT *, sum(l0_tokens) OVER w AS u0, sum(CASE WHEN score >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM r WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT *, score >= 0.4 AND c <= 3 AND u0 + 2000 <= token_budget AND l1_overview <> '' AS e1 FROM a),
d AS (SELECT *, sum(CASE WHEN e1 THEN l1_tokens ELSE l0_tokens END) OVER (PARTITION BY query_id) AS u1 FROM b),
k AS (SELECT *, min(CASE WHEN score >= 0.7 AND u1 + l2_tokens <= token_budget THEN rank END) OVER (PARTITION BY query_id) AS k2 FROM d),
t AS (SELECT *, CASE WHEN rank = k2 AND l2_exists THEN 'l2' WHEN e1 THEN 'l1' ELSE 'l0' END AS tier FROM k),
res AS (SELECT query_id, rank::INTEGER AS rank, doc_id, title, hierarchy_path, {_round('score')} AS score, tier, (CASE tier WHEN 'l2' THEN l2_tokens WHEN 'l1' THEN l1_tokens ELSE l0_tokens END)::BIGINT AS tokens_used, l0_abstract,
  CASE WHEN e1 THEN l1_overview END AS l1_overview, CASE WHEN tier = 'l2' THEN text END AS l2_content FROM t)
"""


def _smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.smart_query(A.vectors(spark, sf_dir), A.document_levels(spark, sf_dir), A.document_texts(spark, sf_dir), A.vector_queries(spark, sf_dir), 10, stretch=2.0)


@query(_SMART + "SELECT * FROM res")
def k2_smart_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smart(spark, sf_dir)


_SUM = "s AS (SELECT query_id, count(*)::BIGINT AS l0_count, count(l1_overview)::BIGINT AS l1_count, count(*) FILTER (WHERE tier = 'l2')::BIGINT AS l2_count, sum(tokens_used)::BIGINT AS total_tokens FROM res GROUP BY query_id)"


@query(_SMART + f", {_SUM} SELECT * FROM s")
def k2_smart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.summaries(_smart(spark, sf_dir))


@query(_SMART + f""", {_SUM}, f AS (SELECT query_id, sum(length(l0_abstract) // 4)::BIGINT AS l0_sum FROM res GROUP BY query_id)
SELECT query_id, 1::INTEGER AS step, 'query ' || query_id AS query_text, NULL::VARCHAR AS agent_id, coalesce(l0_count, 0)::BIGINT AS l0_results, 0::BIGINT AS l1_expansions, 0::BIGINT AS l2_loads, coalesce(l0_sum, 0)::BIGINT AS total_tokens FROM q LEFT JOIN s USING (query_id) LEFT JOIN f USING (query_id)
UNION ALL SELECT query_id, 2, 'query ' || query_id, 'agent', l0_count, l1_count, l2_count, total_tokens FROM s""")
def k2_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.query_log(_smart(spark, sf_dir), A.vector_queries(spark, sf_dir))


@query(f"""WITH {_DOCS}, a AS (SELECT *, ['l0', 'l1', 'l2', 'l3'][doc_id % 4 + 1] AS asked FROM lv), b AS (SELECT *, asked = 'l2' AND NOT l2_exists AS lost FROM a WHERE asked <> 'l3')
SELECT doc_id, CASE WHEN lost THEN 'l1' ELSE asked END AS tier, CASE WHEN asked = 'l0' THEN l0_abstract WHEN asked = 'l1' OR lost THEN (CASE WHEN l1_overview <> '' THEN l1_overview ELSE l0_abstract END) ELSE text END AS content,
(CASE WHEN asked = 'l0' THEN l0_tokens WHEN asked = 'l1' OR lost THEN (CASE WHEN l1_overview <> '' THEN l1_tokens ELSE l0_tokens END) ELSE l2_tokens END)::BIGINT AS tokens, lost AS fallback FROM b""")
def k2_document_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("l"), (F.col("doc_id") % 4).cast("string"))
    return disclosure.document_tier(A.document_levels(spark, sf_dir), A.document_texts(spark, sf_dir), asked)


@query(f"WITH {_DOCS} SELECT doc_id, title, hierarchy_path, 'reference' AS doc_type, l0_tokens::INTEGER AS l0_tokens, l1_tokens::INTEGER AS l1_tokens, l2_tokens::INTEGER AS l2_tokens, false AS is_stale FROM lv ORDER BY doc_id DESC")
def k2_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_levels(spark, sf_dir).select("*", *(F.col(f"l{i}_tokens").alias(f"l{i}_token_count") for i in range(3)), F.lit("reference").alias("doc_type"), F.lit(False).alias("is_stale"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("updated_at"), F.col("doc_id").alias("seq"))
    return disclosure.list_documents(d)


@query(f"WITH {_DOCS} SELECT doc_id, hierarchy_path FROM lv WHERE lower(hierarchy_path) LIKE '/en/src1%'")
def k2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.by_hierarchy(A.document_levels(spark, sf_dir), "/EN/src1").select("doc_id", "hierarchy_path")


@query("""WITH p AS (SELECT '/' || lang || '/' || source AS path, length(text) // 4 AS t FROM documents), a AS (SELECT path, t FROM p UNION ALL SELECT regexp_extract(path, '^/[^/]*'), t FROM p UNION ALL SELECT '', t FROM p),
g AS (SELECT path, count(*)::BIGINT AS documents, sum(t)::BIGINT AS tokens FROM a GROUP BY path), o AS (SELECT *, (row_number() OVER (ORDER BY string_split(path, '/')) - 1)::BIGINT AS pre FROM g)
SELECT o.path, documents, tokens, pre, (pre + (SELECT count(*) FROM g WHERE g.path = o.path OR starts_with(g.path, o.path || '/')) - 1)::BIGINT AS last FROM o""")
def k2_ancestor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens at or below every directory, with its interval."""
    return directories(A.document_levels(spark, sf_dir).select("hierarchy_path", "l2_tokens")).select("path", "documents", "tokens", "pre", "last")


@query("SELECT doc_id, '/' || lang || '/' || source AS hierarchy_path FROM documents WHERE lang = 'en'")
def k2_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents below a directory, as a range of numbers."""
    tree = Hierarchy(spark, scratch(spark)).build(A.document_levels(spark, sf_dir).select("doc_id", "hierarchy_path", "l2_tokens"))
    return tree.subtree("/en/").select("doc_id", "hierarchy_path")


@query("SELECT doc_id, true AS is_stale, 'content changed' AS stale_reason FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 = 0")
def k2_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of texts as they were: every thirteenth had a line more."""
    d = A.table(spark, sf_dir, "documents")
    was = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    rows = A.document_levels(spark, sf_dir).select("doc_id", "l2_file_path").join(d.select("doc_id", F.sha2(was, 256).alias("l2_checksum")), "doc_id")
    return ingest.stale(rows, A.document_texts(spark, sf_dir)).select("doc_id", "is_stale", "stale_reason")


@query(f"WITH {_DOCS} SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS rank, title, l0_tokens::INTEGER AS l0_tokens, sum(l0_tokens) OVER (PARTITION BY query_id)::BIGINT AS total_tokens FROM {_hits_sql(10, 1.0)} JOIN lv USING (doc_id) WHERE score >= 0.1")
def k2_retrieve_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a least score that have a document, with the response's tokens."""
    rows = disclosure.retrieve_l0(disclosure.nearest(A.vectors(spark, sf_dir), A.vector_queries(spark, sf_dir), 10), A.document_levels(spark, sf_dir), 0.1)
    totals = rows.groupBy("query_id").agg(F.sum("l0_tokens").cast("long").alias("total_tokens"))
    return rows.select("query_id", "doc_id", "score", "rank", "title", "l0_tokens").join(totals, "query_id")


@query(f"""WITH {_DOCS}, r AS (SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank)) AS rank, lv.* EXCLUDE (doc_id) FROM {_hits_sql(5, 1.0)} JOIN lv USING (doc_id))
SELECT query_id, doc_id, rank::INTEGER AS rank, CASE WHEN rank IN (1, 3) AND l2_exists THEN 'l2' ELSE 'l0' END AS tier, (CASE WHEN rank IN (1, 3) AND l2_exists THEN l2_tokens ELSE l0_tokens END)::INTEGER AS tokens_used, CASE WHEN rank IN (1, 3) AND l2_exists THEN text END AS l2_content FROM r""")
def k2_load_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts of the first and third result; the index out of range does nothing."""
    hits = disclosure.nearest(A.vectors(spark, sf_dir), A.vector_queries(spark, sf_dir), 5)
    rows = disclosure.expand_l1(disclosure.retrieve_l0(hits, A.document_levels(spark, sf_dir)), indices=[])
    return disclosure.load_l2(rows, A.document_texts(spark, sf_dir), [0, 2, 99]).select("query_id", "doc_id", "rank", "tier", "tokens_used", "l2_content")


@query("SELECT '/' || lang AS path, '/' AS parent_path, lang AS name, count(*)::BIGINT AS doc_count FROM documents GROUP BY lang")
def k2_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.document_levels(spark, sf_dir).select(E.parent_path(F.col("hierarchy_path")).alias("parent_path"))
    return ingest.directories(rows)


def _doc_rows(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """Documents to ingest; changed: those divisible by 13 with a line more, under another id."""
    d = A.table(spark, sf_dir, "documents")
    d = d.filter("doc_id % 13 = 0") if changed else d
    i = F.col("doc_id").cast("string")
    return d.select((F.concat(F.lit("new-"), i) if changed else i).alias("doc_id"), F.concat(F.lit("Doc "), i).alias("title"), F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("hierarchy_path"), F.lit("reference").alias("doc_type"), F.array().cast("array<string>").alias("tags"), (F.concat("text", F.lit("\nmore")) if changed else F.col("text")).alias("content"))


@query(f"""WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 13 = 0 THEN text || chr(10) || 'more' ELSE text END AS text, doc_id FROM documents), e AS (SELECT i, {_L0} AS l0_abstract, length(text) // 4 AS n, sha256(text) AS l2_checksum FROM d)
SELECT i::VARCHAR AS doc_id, l0_abstract, n::INTEGER AS l2_token_count, l2_checksum, false AS is_stale FROM e UNION ALL SELECT 'new-' || i, l0_abstract, n::INTEGER, l2_checksum, false FROM e WHERE i % 13 = 0""")
def k2_regenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose full text another one replaced are found stale and made anew."""
    store = ingest.DocumentStore(spark, scratch(spark))
    store.ingest(_doc_rows(spark, sf_dir))
    store.ingest(_doc_rows(spark, sf_dir, changed=True))
    store.mark_stale()
    store.regenerate(store.documents().filter("is_stale"))
    return store.documents().select("doc_id", "l0_abstract", "l2_token_count", "l2_checksum", "is_stale")


@query(f"WITH {_DOCS}, h AS (SELECT * FROM {_hits_sql(10, 1.0)}) SELECT query_id, rank::INTEGER AS rank, doc_id::VARCHAR AS doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM (SELECT query_id, doc_id, {_round('least(1.0::DOUBLE, c)', 6)} AS score FROM cos)) WHERE rank <= 10")
def k2_stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over vectors that were ingested with their documents."""
    store = ingest.DocumentStore(spark, scratch(spark))
    e = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    store.ingest(e.select("doc_id", F.lit("t").alias("title"), F.concat(F.lit("/v/"), "doc_id").alias("hierarchy_path"), F.lit("reference").alias("doc_type"), F.array().cast("array<string>").alias("tags"), F.lit("text").alias("content"), "embedding"))
    return disclosure.nearest(store.vectors(), A.vector_queries(spark, sf_dir), 10).select("query_id", "rank", "doc_id", "score")


@query(f"""WITH e AS (SELECT doc_id AS i, CASE WHEN doc_id % 13 = 0 THEN text || chr(10) || 'more' ELSE text END AS text FROM documents)
SELECT i::VARCHAR AS doc_id, (length(text) // 4)::INTEGER AS l2_token_count, sha256(text) AS l2_checksum, text AS content FROM e""")
def k2_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and texts from a snapshot, and those replaced twice since, on top."""
    store, again = ingest.DocumentStore(spark, scratch(spark)), _doc_rows(spark, sf_dir, changed=True).withColumn("doc_id", F.substring_index("doc_id", "-", -1))
    store.ingest(_doc_rows(spark, sf_dir))
    store.compact()
    store.ingest(again.withColumn("content", F.lit("in between")))
    store.ingest(again)
    return store.documents().select("doc_id", "l2_token_count", "l2_checksum", "l2_file_path").join(store.contents(), "l2_file_path").drop("l2_file_path")


_ASKED = {"l0": ("State in one sentence what this document is about, what it concludes and what sets it apart.", 12000), "l1": ("Write a dense overview in Markdown: purpose, key points, metrics, relations, use.", 16000)}


@query("SELECT doc_id, " + ", ".join(f"'{t}' || chr(10) || 'Type: reference' || chr(10) || 'Path: /' || lang || chr(10) || 'Title: Doc ' || doc_id || chr(10) || chr(10) || substr(text, 1, {n}) AS {k}" for k, (t, n) in _ASKED.items()) + " FROM documents")
def k2_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summariser model is asked about each document, cut to its input."""
    d = A.table(spark, sf_dir, "documents")
    parts = (F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.concat(F.lit("/"), "lang"), F.lit("reference"), F.col("text"))
    l0, l1 = ingest.prompted(lambda prompt: prompt)(*parts)
    return d.select("doc_id", l0.alias("l0"), l1.alias("l1"))


# --- loading


@query(r"""WITH l AS (SELECT conv_id::VARCHAR AS date, '# ' || conv_id || string_agg(chr(10) || chr(10) || '## ' || role || ' ' || turn || chr(10) || text, '' ORDER BY turn, chr(10) || chr(10) || '## ' || role || ' ' || turn || chr(10) || text) AS content FROM conversations GROUP BY conv_id),
p AS (SELECT date, unnest(string_split(content, chr(10) || '## ')[2:]) AS part, generate_subscripts(string_split(content, chr(10) || '## ')[2:], 1) AS n FROM l)
, b AS (SELECT date, n, trim(string_split(part, chr(10))[1]) AS title, regexp_replace(regexp_replace(substr(part, instr(part, chr(10)) + 1), '^\s+', ''), '\s+$', '') AS body FROM p WHERE contains(part, chr(10)))
SELECT date || 'T12:00:00Z' AS ts, 'observation' AS type, title, substr(body, 1, 200) || (CASE WHEN length(body) > 200 THEN '...' ELSE '' END) AS outcome, ['migrated', date] AS tags, n::INTEGER AS n FROM b""")
def k3_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.log_experiences(A.conversation_logs(spark, sf_dir))


_FACTS = "f AS (SELECT o_orderkey AS id, 'Customer#' || o_custkey AS subject, 'placed' AS predicate, 'order ' || o_orderkey AS object, strftime(o_orderdate, '%Y-%m-%d') AS ts FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL)"


@query(f"WITH {_FACTS}, l AS (SELECT * FROM f ORDER BY id LIMIT 500) SELECT ts, subject, predicate, object, 0.8::DOUBLE AS confidence, 'daemon' AS source, id AS daemon_id, []::VARCHAR[] AS tags FROM l WHERE id NOT IN (SELECT doc_id FROM labels)")
def k3_export_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current facts, the first 500 by id, less those migrated before: the source's limit is the feature."""
    done = A.table(spark, sf_dir, "labels").select(F.lit("facts").alias("source"), F.col("doc_id").cast("string").alias("id"))
    facts = corpus.current_facts(A.order_facts(spark, sf_dir))
    first = facts.orderBy("id").limit(500).withColumn("key", F.col("id"))
    rows = etl.pending(first.withColumn("id", F.col("id").cast("string")), done, "facts").withColumn("id", F.col("key"))
    return etl.fact_payloads(rows.drop("key"))


@query("""WITH e AS (SELECT 'ep-' || doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS c, doc_id, source, lang FROM documents)
SELECT '' AS ts, 'observation' AS type, replace(substr(c, 1, 120), chr(10), ' ') AS title, c AS content, 'ok' AS outcome, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN NULL ELSE 'lang-' || lang END AS source, 0.25::DOUBLE AS importance, id AS daemon_id, []::VARCHAR[] AS tags FROM e WHERE c <> ''""")
def k3_export_episodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.episodes(A.episode_export(spark, sf_dir))


@query("SELECT count(*)::BIGINT AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k3_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.table(spark, sf_dir, "labels").select(F.lit("episodes").alias("source"), F.concat(F.lit("ep-"), F.col("doc_id").cast("string")).alias("id"))
    return etl.pending(A.episode_export(spark, sf_dir), done, "episodes").agg(F.count("*").alias("pending"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS location, 'UTC' AS timezone, ['segment ' || c_mktsegment, 'nation ' || c_nationkey] AS work, ['Project ' || c_custkey] AS projects, 'note ' || c_custkey AS note FROM customer")
def k3_markdown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer")
    s = lambda n: F.col(n).cast("string")
    text = F.concat(
        F.lit("# Profile\n\n## Basics\n- **Name:** "), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n- **Location:** "), "c_mktsegment")).otherwise(""), F.lit("\n- **Timezone:** UTC\n\n## Work\n- segment "), "c_mktsegment",
        F.lit("\nother\n- nation "), s("c_nationkey"), F.lit("\n\n## Projects\n- **Project "), s("c_custkey"), F.lit(":** text\n\n## End\n"),
    )
    note = E.unthink(F.concat(F.lit(" <think>a\nb</think> note "), s("c_custkey"), F.lit("<think></think>\n")))
    return etl.profile(c.select("c_custkey", text.alias("content")), F.col("c_custkey").alias("id"), note.alias("note"))


@query("""SELECT '' AS ts, p_name AS skill_name, p_type AS description, 'daemon' AS category, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS when_to_use, '' AS procedure, (p_size / 100.0)::DOUBLE AS success_rate, 'part-' || p_partkey AS daemon_id, [p_brand] AS tags FROM part""")
def k3_export_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills from an export of parts; odd ones have no trigger."""
    p = A.table(spark, sf_dir, "part")
    fields = [F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("trigger"), (F.col("p_size") / F.lit(100.0)).alias("success_rate"), F.array("p_brand").alias("tags")]
    return etl.skill_payloads(p.select(F.to_json(F.struct(*fields)).alias("raw")))


@query("SELECT 'labels' AS source, doc_id::VARCHAR AS id FROM labels UNION SELECT 'documents', 'ep-' || doc_id FROM documents WHERE doc_id % 11 <> 0 AND text <> ''")
def k3_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids migrated so far and those of an export's episodes."""
    done = A.table(spark, sf_dir, "labels").select(F.lit("labels").alias("source"), F.col("doc_id").cast("string").alias("id"))
    return etl.record_ids(done, etl.episodes(A.episode_export(spark, sf_dir)), "documents")


@query("SELECT 'Doc ' || doc_id AS title, text AS content, '/research/doc-' || doc_id AS hierarchy_path, 'research' AS doc_type, ['research', 'migrated'] AS tags FROM documents")
def k3_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a Markdown corpus to ingest; titles come from the stems."""
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return etl.research_documents(A.table(spark, sf_dir, "documents").select(stem.alias("stem"), E.title_case(stem).alias("title"), F.col("text").alias("content")))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'achievement' ELSE 'failure' END AS type, 'Goal: ' || role AS title, text AS outcome, ['goal', 'execution', CASE WHEN role = 'user' THEN 'success' ELSE 'failure' END] AS tags, 1.5::DOUBLE AS duration_ms,
['consciousness', lower(role), 'm-' || turn] AS cycle_tags, 'm-' || turn AS model, coalesce(role, 'untitled') AS label, [role] AS decoded FROM conversations""")
def k3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that agents write, from turns: goals, cycles, labels and decoded tags."""
    c = A.table(spark, sf_dir, "conversations")
    ts, model = F.lit("2024-01-01T00:00:00Z"), F.concat(F.lit("m-"), F.col("turn").cast("string"))
    g = etl.goal_episode(F.col("role"), F.col("text"), F.col("role") == "user", ts, F.lit(1.5))
    y = etl.cycle_episode(F.col("role"), F.col("text"), model, ts)
    rows = c.select("conv_id", "turn", g.alias("g"), y.alias("y"), E.label(F.lit(""), F.lit(None).cast("string"), F.col("role")).alias("label"), E.tags_list(F.concat(F.lit('["'), "role", F.lit('"]'))).alias("decoded"))
    return rows.select("conv_id", "turn", "g.type", "g.title", "g.outcome", "g.tags", "g.duration_ms", F.col("y.tags").alias("cycle_tags"), "y.model", "label", "decoded")


@query("SELECT 'Nation ' || n_nationkey AS title, '# ' || n_name || chr(10) || 'Region ' || n_regionkey || chr(10) AS content, '/research/nation-' || n_nationkey AS hierarchy_path FROM nation")
def k3_markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of Markdown files, one for each nation, as documents."""
    root, n = scratch(spark), A.table(spark, sf_dir, "nation")
    s = lambda c: F.col(c).cast("string")
    A.text_files(spark, n.select(F.concat(F.lit("nation-"), s("n_nationkey")).alias("name"), F.concat(F.lit("# "), "n_name", F.lit("\nRegion "), s("n_regionkey")).alias("value")), root, ".md")
    return etl.research_documents(corpus.markdown(spark, f"{root}/files")).select("title", "content", "hierarchy_path")


@query("SELECT '2026-02-0' || (r_regionkey + 1) || 'T12:00:00Z' AS ts, 'observation' AS type, r_name AS title, 'Region ' || r_regionkey AS outcome, ['synced', '2026-02-0' || (r_regionkey + 1)] AS tags FROM region")
def k3_dated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily logs from files named by a date, as a live sync takes them."""
    root, r = scratch(spark), A.table(spark, sf_dir, "region")
    s = lambda c: c.cast("string")
    A.text_files(spark, r.select(F.concat(F.lit("2026-02-0"), s(F.col("r_regionkey") + 1)).alias("name"), F.concat(F.lit("# Day\n\n## "), "r_name", F.lit("\nRegion "), s(F.col("r_regionkey"))).alias("value")), root, ".md")
    return etl.log_experiences(corpus.dated_logs(spark, f"{root}/files"), "synced").drop("n")


@query("SELECT 'n-' || n_nationkey AS daemon_id, n_name AS skill_name, CASE WHEN n_nationkey % 2 = 0 THEN 'region ' || n_regionkey ELSE '' END AS when_to_use FROM nation")
def k3_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills from one file with a JSON array; odd ones have no trigger."""
    root, n = scratch(spark), A.table(spark, sf_dir, "nation")
    row = F.struct(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("trigger"))
    A.text_files(spark, n.agg(F.to_json(F.collect_list(row)).alias("value")).withColumn("name", F.lit("skills")), root, ".json")
    return etl.skill_payloads(corpus.json_export(spark, f"{root}/files/skills.json")).select("daemon_id", "skill_name", "when_to_use")


# --- extensions, which the reference describes but does not have


@query(f"WITH {_ENTRIES} SELECT tier, count(*)::BIGINT AS entries FROM entries GROUP BY tier")
def x_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that arrive as a stream of files, counted by tier: the stream's result is the batch's."""
    root = scratch(spark)
    A.event_entries(spark, sf_dir).select(F.col("raw").alias("value"), "tier", "file").write.partitionBy("tier", "file").text(f"{root}/in")
    append_stream(spark, f"{root}/in", root).awaitTermination()
    return streamed(spark, root).groupBy("tier").agg(F.count("*").alias("entries"))


@query(f"""WITH {_ENTRIES}, {_DOCS.lstrip()}, h AS {_hits_sql(20, 1.0)}
SELECT query_id, doc_id, {_round('score * weight * recency', 6)} AS hybrid FROM h JOIN aged ON aged.event_id = h.doc_id""")
def x_hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity x weight x recency of the nearest vectors."""
    hits = disclosure.nearest(A.vectors(spark, sf_dir), A.vector_queries(spark, sf_dir), 20)
    e = A.event_entries(spark, sf_dir).select(F.col("event_id").alias("doc_id"), "weight", "ts")
    return hits.join(e, "doc_id").select("query_id", "doc_id", E.half_up(F.col("score") * F.col("weight") * E.recency(F.col("ts"), A.now()), 6).alias("hybrid"))
