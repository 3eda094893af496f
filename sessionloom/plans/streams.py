"""Streaming queries over the event files; their SQL is that of the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, intervals, sessions
from ..operators.graph import shared_folder
from ..sources import views
from ..streaming import derivation, jobs
from . import events


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # a glob, because a table may be one file or a folder of files, and a stream takes a plain path for a folder
    return spark.readStream.schema(views.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def streaming_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs.run_to_table(jobs.label_stream(views.raw_events(_stream(spark, sf, "events"))), "intervals")
    return rows.select("session_id", "raw_event_id", "interval_ordinal", "opens")


def streaming_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh event is delivered twice in the stream."""
    raw = views.raw_events(_stream(spark, sf, "events"))
    twice = F.when(F.col("raw_event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = raw.withColumn("again", F.explode(twice)).withColumn("arrival", F.col("raw_event_id") * 2 + F.col("again")).drop("again")
    return jobs.run_to_table(sent, "ledger", jobs.append_batch).select("workspace_id", "external_event_id", "arrival")


def streaming_derive(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots to chunk counts in micro-batches."""
    rows = _stream(spark, sf, "documents").select("doc_id", F.size(T.chunk_bounds(F.size(T.tokens(F.col("text"))))).alias("n_chunks"))
    return jobs.run_to_table(rows, "derived").select("doc_id", "n_chunks")


def _sent_twice(raw: DataFrame) -> DataFrame:
    """Events in the order of their ids, whatever their times; every seventh comes again a hundred events later."""
    twice = F.when(F.col("raw_event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return raw.withColumn("again", F.explode(twice)).withColumn("arrival", F.col("raw_event_id") * 2 + F.col("again") * 201).drop("again")


def arrival_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals in order of arrival, each event applied once however often it is sent."""
    sent = intervals.first_deliveries(_sent_twice(views.raw_events(views.table(spark, sf, "events"))))
    return intervals.labelled(sent, ["arrival"]).select("session_id", "raw_event_id", "interval_ordinal", "opens")


def streaming_redelivery(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the state machine, whose state remembers what was applied."""
    rows = jobs.run_to_table(jobs.label_stream(_sent_twice(views.raw_events(_stream(spark, sf, "events")))), "redelivered")
    return rows.select("session_id", "raw_event_id", "interval_ordinal", "opens")


def streaming_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Current claims from a stream in which every seventh event comes twice."""
    raw = views.claim_events(_stream(spark, sf, "events")).withColumn("raw_event_id", F.col("seq"))
    sent = _sent_twice(raw.withColumn("governed", claims.governed(F.col("event_type"), F.col("evidence_type"))))
    with jobs.state_store(spark):
        changes = jobs.run_to_table(jobs.claim_stream(sent), "claims", jobs.write_changes)
    rows = jobs.newest_claims(changes.drop("part")).withColumn("occurred_at", F.timestamp_micros("occurred_us").cast("timestamp_ntz"))
    rows = rows.withColumn("state", claims.state_of(F.col("event_type"))).withColumn("confidence", events.score(rows))
    return rows.select("workspace_id", "claim_key", "state", F.col("occurred_at").alias("observed_at"), "confidence", "latest_seq", "pinned", "watched", "last_review", "n_advances")


def derivation_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records, every tenth cut short: status, attempts, segments and vectors when nothing waits any more."""
    whole = F.to_json(F.struct("text"))
    cut = F.when(F.col("doc_id") % 10 == 3, F.expr("left(to_json(struct(text)), length(to_json(struct(text))) - 1)")).otherwise(whole)
    records = _stream(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), cut.alias("content"))
    base = f"{shared_folder(spark)}/derivation-{uuid.uuid4().hex}"
    job = derivation.Derivation(spark, base, sessions.hashing_embedder(16), 16).prepare()
    job.run(records)
    job.settle()
    vectors = job.table("embeddings").where("valid").select("segment_id").distinct().withColumn("has", F.lit(1))
    counts = job.table("segments").join(vectors, "segment_id", "left").groupBy("record_id").agg(F.count("*").alias("n_segments"), F.count("has").alias("n_vectors"))
    return job.status().join(counts, "record_id", "left").select("record_id", "status", "attempts", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


_ARRIVAL = events._LABELLED.replace("ORDER BY occurred_at, raw_event_id", "ORDER BY raw_event_id")

ORACLES = {
    "arrival_intervals": f"WITH {_ARRIVAL} SELECT session_id, raw_event_id, interval_ordinal, opens FROM l3",
    "streaming_redelivery": f"WITH {_ARRIVAL} SELECT session_id, raw_event_id, interval_ordinal, opens FROM l3",
    "streaming_claims": f"WITH RECURSIVE {events._CLAIMS} SELECT * FROM cc",
    "streaming_intervals": f"WITH {events._LABELLED} SELECT session_id, raw_event_id, interval_ordinal, opens FROM l3",
    "streaming_ledger": f"WITH {events._RAW} SELECT workspace_id, external_event_id, raw_event_id * 2 AS arrival FROM raw",
    "derivation_stream": """SELECT doc_id AS record_id, CASE WHEN cut THEN 'failed' ELSE 'derived' END AS status, CASE WHEN cut THEN 5 ELSE 0 END AS attempts, CASE WHEN cut THEN 0 ELSE k END AS n_segments, CASE WHEN cut THEN 0 ELSE k END AS n_vectors
      FROM (SELECT doc_id, doc_id % 10 = 3 AS cut, CASE WHEN n = 0 THEN 0 WHEN n <= 1200 THEN 1 ELSE greatest(2, ceil((n - 125) / 875.0)) END::BIGINT AS k FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n FROM documents))""",
    "streaming_derive": "SELECT doc_id, (CASE WHEN n = 0 THEN 0 WHEN n <= 1200 THEN 1 ELSE greatest(2, ceil((n - 125) / 875.0)) END)::INT AS n_chunks FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)",
}

QUERIES = {name: globals()[name] for name in ORACLES}
