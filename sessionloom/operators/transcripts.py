"""Transcript scans and normalisation: JSONL lines with spans, and two record formats to turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMAT_A = "type string, uuid string, timestamp string, sessionId string, session_id string, cwd string, isSidechain boolean, aiTitle string, message struct<role: string, model: string, content: variant>"
PARTS_A = "array<struct<type: string, text: string, thinking: string, id: string, name: string, input: string, tool_use_id: string, content: string>>"
FORMAT_B = "timestamp string, type string, payload struct<type: string, id: string, cwd: string, model: string, turn_id: string, role: string, message: string, name: string, arguments: string, call_id: string, output: string, content: array<struct<type: string, text: string>>>"
TURN = ["record_id", "line", "part", "role", "actor_kind", "kind", "text", "call_id", "tool_name", "model", "cwd", "started_at"]


def scan_lines(records: DataFrame) -> DataFrame:
    """(record_id, body) to non-blank lines with line number, character and byte spans, and whether they parse.

    Lines that parse but are no objects are dropped; a carriage return before the line feed is not part of a line.
    """
    raw = records.select("record_id", F.posexplode(F.split("body", "\n")).alias("line", "raw"))
    before = Window.partitionBy("record_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda size: F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    rows = raw.withColumns({"char_start": start(F.length("raw")), "byte_start": start(F.octet_length("raw"))}).withColumn("text", F.regexp_replace("raw", "\r$", ""))
    rows = rows.where(F.trim("text") != "").withColumn("v", F.try_parse_json("text"))
    rows = rows.where(F.col("v").isNull() | F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select("record_id", "line", "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "byte_start", (F.col("byte_start") + F.octet_length("text")).alias("byte_end"), F.col("v").isNotNull().alias("parsed"))


def scan_documents(records: DataFrame) -> DataFrame:
    """(record_id, body), each one JSON text, to its objects: the text itself or the items of its list.

    Each object has its place as line number; all have the span of the whole body. Items that are no objects are
    dropped; a body that does not parse is one row with ``parsed`` false.
    """
    rows = records.withColumn("v", F.try_parse_json("body"))
    listed = F.schema_of_variant("v").startswith("ARRAY")
    items = F.when(F.col("v").isNull(), F.array("body")).when(listed, F.from_json("body", "array<string>")).otherwise(F.array("body"))
    rows = rows.select("record_id", "body", F.col("v").isNotNull().alias("parsed"), F.posexplode(items).alias("line", "text"))
    rows = rows.where(~F.col("parsed") | F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False)))
    return rows.select("record_id", "line", "text", F.lit(0).alias("char_start"), F.length("body").alias("char_end"), F.lit(0).alias("byte_start"), F.octet_length("body").alias("byte_end"), "parsed")


def role_of(role: Column) -> Column:
    """Developers speak as the system; unknown roles too."""
    return F.when(role == "developer", "system").when(role.isin("user", "assistant", "system", "tool"), role).otherwise("system")


def actor_of(role: Column, tool: Column) -> Column:
    return F.when(tool.isin("Agent", "Task"), "subagent").when(role == "user", "human").when(role == "assistant", "agent").when(role == "tool", "tool").otherwise("system")


def _carried(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns that hold their last given value through the record."""
    w = Window.partitionBy("record_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({k: F.last(c, ignorenulls=True).over(w) for k, c in columns.items()})


def _named(turns: DataFrame) -> DataFrame:
    """Tool results get the name of the call with their id."""
    calls = turns.where("kind = 'tool_call'").groupBy("record_id", "call_id").agg(F.max_by("tool_name", "line").alias("_name"))
    out = turns.join(calls, ["record_id", "call_id"], "left").withColumn("tool_name", F.coalesce("tool_name", "_name"))
    return out.withColumn("actor_kind", actor_of(F.col("role"), F.when(F.col("kind") == "tool_call", F.col("tool_name")))).select(*TURN)


def turns_a(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Message records: (turns, lifecycle events). One record may give several turns, one for each content part; a
    content that is a plain string is one text."""
    rows = lines.where("parsed").withColumn("r", F.from_json("text", FORMAT_A))
    rows = _carried(rows, cwd=F.col("r.cwd"), model=F.col("r.message.model"))
    life = F.col("r.message").isNull()
    content = F.col("r.message.content")
    said = F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get(content, "$", "string").alias("text")))), PARTS_A)
    content = F.when(F.schema_of_variant(content) == "STRING", said).otherwise(F.from_json(F.to_json(content), PARTS_A))
    parts = rows.where(~life).select("record_id", "line", "model", "cwd", "r", F.posexplode(content).alias("part", "p"))
    kind = F.when(F.col("p.type") == "tool_use", "tool_call").when(F.col("p.type") == "tool_result", "tool_result").when(F.col("p.type") == "thinking", "thinking").otherwise("text")
    role = F.when(kind == "tool_result", "tool").otherwise(role_of(F.col("r.message.role")))
    text = F.coalesce("p.text", "p.thinking", "p.input", "p.content", F.lit(""))
    turns = parts.select("record_id", "line", "part", role.alias("role"), F.lit(None).cast("string").alias("actor_kind"), kind.alias("kind"), text.alias("text"), F.coalesce("p.id", "p.tool_use_id").alias("call_id"), F.col("p.name").alias("tool_name"), "model", "cwd", F.try_to_timestamp(F.col("r.timestamp")).alias("started_at"))
    return _named(turns), rows.where(life).select("record_id", "line", F.col("r.type").alias("type"), F.length("text").alias("length"), F.col("r.aiTitle").alias("title"))


def turns_b(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed payload records: (turns, lifecycle events). Event messages that repeat a response message are dropped."""
    rows = lines.where("parsed").withColumn("r", F.from_json("text", FORMAT_B))
    context = F.col("r.type") == "turn_context"
    rows = _carried(rows, cwd=F.coalesce(F.when(context | (F.col("r.type") == "session_meta"), F.col("r.payload.cwd"))), model=F.when(context, F.col("r.payload.model")))
    kind_of = F.col("r.payload.type")
    response = F.col("r.type") == "response_item"
    kind = F.when(response & kind_of.isin("function_call", "custom_tool_call", "web_search_call", "tool_search_call"), "tool_call").when(response & kind_of.isin("function_call_output", "custom_tool_call_output", "tool_search_output"), "tool_result").when(response & (kind_of == "reasoning"), "thinking").when(response & (kind_of == "message"), "text").when((F.col("r.type") == "event_msg") & kind_of.isin("user_message", "agent_message"), "text")
    role = F.when(kind == "tool_result", "tool").when(F.col("r.type") == "event_msg", F.when(kind_of == "user_message", "user").otherwise("assistant")).when(kind.isin("tool_call", "thinking"), "assistant").otherwise(role_of(F.col("r.payload.role")))
    said = F.array_join(F.transform("r.payload.content", lambda c: F.coalesce(c["text"], F.lit(""))), "")
    text = F.coalesce("r.payload.message", "r.payload.arguments", "r.payload.output", said, F.lit(""))
    coded = rows.select("record_id", "line", F.lit(0).alias("part"), role.alias("role"), F.lit(None).cast("string").alias("actor_kind"), kind.alias("kind"), text.alias("text"), F.col("r.payload.call_id").alias("call_id"), F.col("r.payload.name").alias("tool_name"), "model", "cwd", F.try_to_timestamp(F.col("r.timestamp")).alias("started_at"), F.coalesce("r.timestamp", F.lit("")).alias("stamp"), F.col("r.type").alias("type"))
    spoken = coded.where("kind IS NOT NULL")
    response_messages = spoken.where("type = 'response_item' AND kind = 'text'").select("record_id", "role", "stamp", "text").distinct()
    events = spoken.where("type = 'event_msg'").join(response_messages, ["record_id", "role", "stamp", "text"], "left_anti").select(*spoken.columns)
    turns = spoken.where("type <> 'event_msg'").unionByName(events)
    return _named(turns.select(*TURN)), coded.where("kind IS NULL").select("record_id", "line", "type", F.length("text").alias("length"), F.lit(None).cast("string").alias("title"))


def bounds(turns: DataFrame) -> DataFrame:
    """Start, last activity, number of turns and last model and folder of each transcript."""
    return turns.groupBy("record_id").agg(F.count("*").alias("n_turns"), F.min("started_at").alias("started_at"), F.max("started_at").alias("last_activity_at"), F.max_by("model", F.struct("line", "part")).alias("model"), F.max_by("cwd", F.struct("line", "part")).alias("cwd"))


def identity(lines: DataFrame, given: DataFrame) -> DataFrame:
    """Session ids by precedence: derived side chain (parent:subagent:id), given, detected; else a digest of the locator."""
    rows = lines.where("parsed").withColumn("r", F.from_json("text", FORMAT_A))
    found = rows.groupBy("record_id").agg(F.min_by("r.sessionId", F.when(F.col("r.sessionId").isNotNull(), F.col("line"))).alias("detected"), F.bool_or(F.coalesce("r.isSidechain", F.lit(False))).alias("side"))
    both = given.join(found, "record_id", "left")
    side = F.when(F.col("side") & F.col("agent_id").isNotNull(), F.concat_ws(":", "detected", F.lit("subagent"), "agent_id"))
    place = F.sha2(F.lower(F.trim("locator")), 256)
    return both.select("record_id", F.coalesce(side, "given_id", "detected").alias("harness_session_id"), F.when(F.coalesce(side, "given_id", "detected").isNull(), place).alias("locator_hash"))
