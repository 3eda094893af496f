"""Queries of the service's look-ups, checks and run ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, service, sessions
from ..sources import views
from ..streaming import jobs
from . import events
from .streams import _stream


def _workspace(number: Column) -> Column:
    return F.concat(F.lit("w"), (number % 4).cast("string"))


def identity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of all events looked up among conversations (as sessions) and documents (as records)."""
    ids = views.table(spark, sf, "events").select(_workspace(F.col("event_id")).alias("workspace_id"), F.col("event_id").cast("string").alias("id"))
    own = views.table(spark, sf, "conversations").select(_workspace(F.col("conv_id")).alias("workspace_id"), F.col("conv_id").alias("session_id")).distinct()
    held = views.table(spark, sf, "documents").select(_workspace(F.col("doc_id")).alias("workspace_id"), F.floor(F.col("doc_id") / 2).alias("session_id"), F.col("doc_id").alias("record_id"))
    return service.identities(ids, own, held)


def activation_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = service.activation_events(views.raw_events(views.table(spark, sf, "events")))
    return rows.select("workspace_id", "raw_event_id", F.col("rank").cast("long").alias("rank"))


def workspace_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as workspaces with their suppliers as bindings of two types."""
    spaces = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("handle"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "codex").otherwise("claude")
    bindings = views.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("workspace_id"), kind.alias("binding_type"), F.concat(F.lit("file:"), F.col("s_suppkey").cast("string")).alias("uri"))
    return service.listing(spaces, bindings).select("handle", "binding_type", "uri", F.col("place").cast("long").alias("place"))


def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence made of all events: some name no event, another workspace or another external id."""
    raw = views.raw_events(views.table(spark, sf, "events"))
    n = F.col("raw_event_id")
    evidence = raw.select(
        n.alias("evidence_id"), F.when(n % 5 == 0, -n - 1).otherwise(n).alias("raw_event_id"), F.when(n % 7 == 0, "elsewhere").otherwise(F.col("workspace_id")).alias("workspace_id"),
        "source_id", F.when(n % 11 == 0, F.lit(None)).otherwise(F.col("external_event_id")).alias("external_event_id"),
    )
    return service.evidence_codes(evidence, raw).select("evidence_id", "code")


TABLES = ["raw_events", "activity_intervals", "claim_events", "session_turns", "raw_records", "segments", "embeddings", "findings", "edges"]


def erasure_impact(spark: SparkSession, sf: str) -> DataFrame:
    """What goes with every tenth user's session from nine tables, in one row per session."""
    t = lambda name: views.table(spark, sf, name)
    raw, docs = views.raw_events(t("events")), t("documents")
    by = lambda df, key: df.select(F.col(key).cast("string").alias("session_id"))
    chunks = docs.select("doc_id", F.explode(T.chunk_bounds(F.size(T.tokens(F.col("text"))))).alias("c"))
    held = [raw, intervals.intervals(raw, ["occurred_at", "raw_event_id"]), by(views.claim_events(t("events")), "claim_key"), by(t("conversations"), "conv_id"), by(docs, "doc_id"), by(chunks, "doc_id"), by(t("embeddings"), "vec_id"), by(t("labels"), "doc_id"), by(views.continuation_edges(t("conversations")), "source")]
    gone = raw.where(F.col("session_id").cast("long") % 10 == 0)
    return service.impact(sessions.erase(dict(zip(TABLES, held, strict=True)), gone)[1], TABLES)


def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    raw = views.raw_events(views.table(spark, sf, "events"))
    rows = intervals.labelled(raw, ["occurred_at", "raw_event_id"]).where(F.col("opens") | (F.col("stops") & (F.col("hook") == "Stop")))
    records = views.table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("captured").alias("status"))
    queued = raw.where("raw_event_id % 9 = 0 AND hook = 'Stop'").select("workspace_id", "raw_event_id", F.lit("failed").alias("status"))
    return service.backfill(records, raw, rows.select("workspace_id", "raw_event_id"), queued)


def extraction_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Records and queue after the backfill, as one table."""
    derived, queue = _history(spark, sf)
    return derived.select(F.lit("record").alias("kind"), F.col("record_id").alias("id"), "status").unionByName(queue.select(F.lit("queue").alias("kind"), F.col("raw_event_id").alias("id"), "status"))


def settled_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The queue of all boundaries after the stream of intervals has applied every event, with what is left pending."""
    raw = views.raw_events(views.table(spark, sf, "events"))
    queue = raw.where("hook <> 'UserPromptSubmit'").select("raw_event_id", "session_id", F.when(F.col("raw_event_id") % 13 == 0, "failed").otherwise("pending").alias("status"))
    applied = jobs.run_to_table(jobs.label_stream(views.raw_events(_stream(spark, sf, "events"))), "settled")
    return service.settle(queue, applied.where("opens OR settled IS NOT NULL"))


def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-batches of a ledger stream leave a row each; here the rows that each job has read in all."""
    raw = views.raw_events(_stream(spark, sf, "events")).withColumn("arrival", F.col("raw_event_id"))
    out, runs = jobs.run_with_ledger(raw, "ledger", jobs.append_batch)
    return runs.groupBy("job", "status").agg(F.sum("n_rows").alias("n_rows"), F.max(F.col("error")).alias("error"), (F.min("finished_at") >= F.min("started_at")).alias("in_order"))


_CODE = "CASE WHEN event_id % 5 = 0 THEN 'missing_event' WHEN event_id % 7 = 0 THEN 'foreign_workspace' WHEN event_id % 11 = 0 THEN 'source_mismatch' END"
_PER = [
    ("raw_events", "SELECT user_id AS s FROM events"),
    ("activity_intervals", "SELECT session_id::BIGINT AS s FROM ivals"),
    ("claim_events", "SELECT user_id AS s FROM events"),
    ("session_turns", "SELECT conv_id AS s FROM conversations"),
    ("raw_records", "SELECT doc_id AS s FROM documents"),
    ("segments", "SELECT doc_id AS s FROM (SELECT doc_id, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 1200 THEN 1 ELSE greatest(2, ceil((n - 125) / 875.0))::INT END)) FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents))"),
    ("embeddings", "SELECT vec_id AS s FROM embeddings"),
    ("findings", "SELECT doc_id AS s FROM labels"),
    ("edges", "SELECT DISTINCT a.conv_id AS s FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 5 <> 4"),
]
_COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS t, s FROM ({sql})" for name, sql in _PER)
_USED = f"{events._LABELLED}, used AS (SELECT raw_event_id FROM l3 WHERE opens OR (stops AND hook = 'Stop'))"

ORACLES = {
    "identity_lookup": """WITH e AS (SELECT DISTINCT event_id AS id FROM events), c AS (SELECT DISTINCT conv_id FROM conversations)
      SELECT 'w' || (id % 4) AS workspace_id, id::VARCHAR AS id, coalesce(conv_id, doc_id // 2) AS session_id, CASE WHEN conv_id IS NULL THEN doc_id END AS record_id FROM e LEFT JOIN c ON conv_id = id LEFT JOIN documents ON doc_id = id WHERE conv_id IS NOT NULL OR doc_id IS NOT NULL""",
    "activation_events": f"WITH {events._RAW} SELECT workspace_id, raw_event_id, row_number() OVER (PARTITION BY workspace_id, source_id ORDER BY occurred_at DESC, raw_event_id DESC) AS rank FROM raw WHERE hook <> 'Stop' QUALIFY rank <= 50",
    "workspace_listing": "WITH b AS (SELECT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'codex' ELSE 'claude' END AS binding_type, 'file:' || s_suppkey AS uri FROM supplier) SELECT n_name AS handle, binding_type, uri, CASE WHEN uri IS NOT NULL THEN row_number() OVER (PARTITION BY n_nationkey ORDER BY binding_type, uri) END AS place FROM nation LEFT JOIN b ON s_nationkey = n_nationkey",
    "evidence_check": f"SELECT event_id AS evidence_id, {_CODE} AS code FROM events",
    "erasure_impact": f"WITH {events._LABELLED}, k AS ({_COUNTS}) SELECT s::VARCHAR AS session_id, {', '.join(f'''count(*) FILTER (t = '{n}') AS {n}''' for n in TABLES)}, count(*) AS total FROM k WHERE s % 10 = 0 AND s IN (SELECT user_id FROM events) GROUP BY s",
    "extraction_backfill": f"""WITH {_USED} SELECT 'record' AS kind, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'derived' END AS status FROM documents
      UNION ALL SELECT 'queue', raw_event_id, CASE WHEN raw_event_id % 9 = 0 AND hook = 'Stop' THEN 'failed' ELSE 'pending' END FROM raw WHERE hook <> 'UserPromptSubmit' AND ((raw_event_id % 9 = 0 AND hook = 'Stop') OR raw_event_id NOT IN (SELECT raw_event_id FROM used))""",
    "settled_queue": f"WITH {events._LABELLED} SELECT raw_event_id, session_id, CASE WHEN raw_event_id % 13 = 0 THEN 'failed' WHEN opens OR (stops AND hook = 'Stop') THEN 'settled' ELSE 'pending' END AS status FROM l3 WHERE hook <> 'UserPromptSubmit'",
    "run_ledger": "SELECT 'ledger' AS job, 'ok' AS status, count(*)::BIGINT AS n_rows, NULL::VARCHAR AS error, true AS in_order FROM events",
}

QUERIES = {name: globals()[name] for name in ORACLES}
