"""Transcript queries: both record formats are written out from ``conversations`` and read back. With their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transcripts
from ..sources import views


def _bodies(rows: DataFrame, head: Column, lines: Column) -> DataFrame:
    """One JSONL body per conversation: a head line, its turns' lines, and for every fifth a blank and a broken line."""
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", lines.alias("l")))).alias("ls"))
    tail = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit(""), F.lit("{broken"), F.lit("[1]"))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(F.array(head), F.flatten(F.transform("ls", lambda x: x["l"])), tail), "\n")
    return grouped.select(F.col("conv_id").cast("string").alias("record_id"), body.alias("body"))


def _stamp() -> Column:
    return F.concat(F.lit("2024-01-01T00:00:0"), F.col("turn").cast("string"), F.lit("Z"))


def _format_a(spark: SparkSession, sf: str) -> DataFrame:
    """User and system turns are messages; assistants think, speak and call a tool whose result is the user's next line."""
    call = F.concat(F.lit("t"), F.col("turn").cast("string"))
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    record = lambda content, role: F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), _stamp().alias("timestamp"), F.struct(role.alias("role"), F.when(role == "assistant", F.lit("m1")).alias("model"), content.alias("content")).alias("message")))
    agent = F.to_json(F.struct(F.lit("message").alias("type"), _stamp().alias("timestamp"), F.struct(F.lit("assistant").alias("role"), F.lit("m1").alias("model"), F.array(
        F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("thinking"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("thinking"), F.col("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("text"), call.alias("id"), F.lit("grep").alias("name")),
    ).alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("message").alias("type"), _stamp().alias("timestamp"), F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), F.lit("ok").alias("content"))).alias("content")).alias("message")))
    lines = F.when(F.col("role") == "assistant", F.array(agent, result)).otherwise(F.array(record(plain, F.col("role"))))
    head = F.to_json(F.struct(F.lit("ai-title").alias("type"), F.concat(F.lit("title "), F.col("conv_id").cast("string")).alias("aiTitle"), F.concat(F.lit("/w/"), F.col("conv_id").cast("string")).alias("cwd")))
    return _bodies(views.table(spark, sf, "conversations"), head, lines)


def _format_b(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn is a response message; user turns also come as an event message that repeats it (even turns) or not."""
    rows = views.table(spark, sf, "conversations")
    message = F.to_json(F.struct(_stamp().alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.when(F.col("role") == "system", "developer").otherwise(F.col("role")).alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("payload")))
    event = F.to_json(F.struct(_stamp().alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("aside").alias("message")).alias("payload")))
    lines = F.when(F.col("role") == "user", F.array(event, message)).otherwise(F.array(message))
    head = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.lit("m2").alias("model"), F.concat(F.lit("/w/"), F.col("conv_id").cast("string")).alias("cwd")).alias("payload")))
    return _bodies(rows, head, lines)


def transcript_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their spans: the text that the span cuts from the body must be the line."""
    bodies = _format_b(spark, sf)
    lines = transcripts.scan_lines(bodies).join(bodies, "record_id")
    same = F.expr("substring(body, cast(char_start + 1 as int), cast(char_end - char_start as int))") == F.col("text")
    return lines.groupBy("record_id").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("parsed")).alias("n_bad"), F.bool_and(same).alias("spans_hold"), F.bool_and(F.col("byte_end") - F.col("byte_start") >= F.col("char_end") - F.col("char_start")).alias("bytes_hold"))


def transcript_turns_a(spark: SparkSession, sf: str) -> DataFrame:
    turns, _ = transcripts.turns_a(transcripts.scan_lines(_format_a(spark, sf)))
    return turns.groupBy("record_id", "role", "actor_kind", "kind", "tool_name", "cwd").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def transcript_turns_b(spark: SparkSession, sf: str) -> DataFrame:
    turns, _ = transcripts.turns_b(transcripts.scan_lines(_format_b(spark, sf)))
    return turns.groupBy("record_id", "role", "model").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def transcript_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    _, life = transcripts.turns_a(transcripts.scan_lines(_format_a(spark, sf)))
    return life.select("record_id", "type", "title")


def transcript_bounds(spark: SparkSession, sf: str) -> DataFrame:
    turns, _ = transcripts.turns_a(transcripts.scan_lines(_format_a(spark, sf)))
    return transcripts.bounds(turns).select("record_id", "n_turns", F.date_format("started_at", "HH:mm:ss").alias("started"), F.date_format("last_activity_at", "HH:mm:ss").alias("last"), "model")


def transcript_identity(spark: SparkSession, sf: str) -> DataFrame:
    bodies = _format_a(spark, sf)
    n = F.col("record_id").cast("long")
    given = bodies.select("record_id", F.when(n % 3 == 0, F.concat(F.lit("g"), "record_id")).alias("given_id"), F.lit(None).cast("string").alias("agent_id"), F.concat(F.lit(" /T/"), "record_id").alias("locator"))
    return transcripts.identity(transcripts.scan_lines(bodies), given)


ORACLES = {
    "transcript_scan": "SELECT conv_id::VARCHAR AS record_id, count(*) + 1 + count(*) FILTER (role = 'user') + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS n_lines, (conv_id % 5 = 0)::BIGINT AS n_bad, true AS spans_hold, true AS bytes_hold FROM conversations GROUP BY conv_id",
    "transcript_turns_a": """WITH t AS (SELECT conv_id, role, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'agent' ELSE 'system' END AS actor_kind, 'text' AS kind, NULL AS tool_name, length(text) AS n FROM conversations
      UNION ALL SELECT conv_id, 'assistant', 'agent', 'thinking', NULL, 2 FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, 'assistant', 'agent', 'tool_call', 'grep', 0 FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, 'tool', 'tool', 'tool_result', 'grep', 2 FROM conversations WHERE role = 'assistant')
      SELECT conv_id::VARCHAR AS record_id, role, actor_kind, kind, tool_name, '/w/' || conv_id AS cwd, count(*) AS n, sum(n)::BIGINT AS n_chars FROM t GROUP BY ALL""",
    "transcript_turns_b": """WITH t AS (SELECT conv_id, role, length(text) AS n FROM conversations UNION ALL SELECT conv_id, 'user', 5 FROM conversations WHERE role = 'user' AND turn % 2 = 1)
      SELECT conv_id::VARCHAR AS record_id, role, 'm2' AS model, count(*) AS n, sum(n)::BIGINT AS n_chars FROM t GROUP BY ALL""",
    "transcript_lifecycle": "SELECT DISTINCT conv_id::VARCHAR AS record_id, 'ai-title' AS type, 'title ' || conv_id AS title FROM conversations",
    "transcript_bounds": "SELECT conv_id::VARCHAR AS record_id, count(*) + 3 * count(*) FILTER (role = 'assistant') AS n_turns, '00:00:0' || min(turn) AS started, '00:00:0' || max(turn) AS last, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'm1' END AS model FROM conversations GROUP BY conv_id",
    "transcript_identity": "SELECT conv_id::VARCHAR AS record_id, coalesce(CASE WHEN conv_id % 3 = 0 THEN 'g' || conv_id END, CASE WHEN count(*) FILTER (role <> 'assistant') > 0 THEN 's' || conv_id END) AS harness_session_id, CASE WHEN conv_id % 3 <> 0 AND count(*) FILTER (role <> 'assistant') = 0 THEN sha256('/t/' || conv_id) END AS locator_hash FROM conversations GROUP BY conv_id",
}

QUERIES = {name: globals()[name] for name in ORACLES}
