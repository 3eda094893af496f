"""Domain tables derived from the given tables by projection only, so that every job scales with its input.

``events`` stands for hook events, ``conversations`` for transcript turns, ``documents`` for transcript snapshots
and ``embeddings`` for segment vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(events: DataFrame) -> DataFrame:
    """The event ledger's columns: purchases stop a session, sign-ups start one afresh, others are prompts."""
    hook = F.when(F.col("event_type") == "purchase", "Stop").when(F.col("event_type") == "signup", "SessionStart").otherwise("UserPromptSubmit")
    start = F.when(F.col("event_type") == "signup", "clear")
    return events.select(
        F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"),
        F.lit("codex").alias("source_type"),
        F.lit("codex:local").alias("source_id"),
        F.col("event_id").cast("string").alias("external_event_id"),
        F.col("event_id").alias("raw_event_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("codex."), hook).alias("event_type"),
        hook.alias("hook"),
        start.alias("start_source"),
        F.col("ts").alias("occurred_at"),
        F.col("value"),
        F.col("props").alias("payload"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    """Transcript turns: one session per conversation."""
    return conversations.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("ordinal"),
        "role",
        F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "agent").otherwise("system").alias("actor_kind"),
        "text",
    )


def tool_turns(conversations: DataFrame) -> DataFrame:
    """A stand-in for tool parts: assistants call, later user turns answer, the rest is text."""
    part = F.when(F.col("role") == "assistant", "tool_call").when((F.col("role") == "user") & (F.col("turn") > 0), "tool_result").otherwise("text")
    call = F.when(part != "text", F.concat_ws("-", F.col("conv_id").cast("string"), F.floor((F.col("turn") + 1) / 2).cast("string")))
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), part.alias("part_type"), call.alias("call_id"))


def snapshots(documents: DataFrame) -> DataFrame:
    """Successive transcript snapshots: a session per source, captured in the order of the ids."""
    return documents.select(F.col("source").alias("session_id"), F.col("doc_id").alias("captured"), F.col("text").alias("content"))


def claim_events(events: DataFrame) -> DataFrame:
    """Claim events: one claim per user; the event type gives the kind of event, every other promotion is a decision."""
    kind = (
        F.when(F.col("event_type") == "signup", "extracted")
        .when(F.col("event_type") == "view", "supported")
        .when(F.col("event_type") == "click", F.element_at(F.array(*[F.lit(x) for x in ("pinned", "watched", "unpinned", "unwatched")]), (F.col("event_id") % 4 + 1).cast("int")))
        .when(F.col("event_type") == "purchase", "promoted")
        .otherwise("contradicted")
    )
    return events.select(
        F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"),
        F.col("user_id").alias("claim_key"),
        F.col("event_id").alias("seq"),
        kind.alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("base"),
        F.when(F.col("event_id") % 2 == 0, "claim.promotion").otherwise("session.note").alias("evidence_type"),
    )


def continuation_edges(conversations: DataFrame) -> DataFrame:
    """Continuations: a session and the next number, in chains of five."""
    sessions = conversations.select(F.col("conv_id").alias("source")).distinct()
    following = sessions.select(F.col("source").alias("target"))
    return sessions.where("source % 5 <> 4").join(following, F.col("target") == F.col("source") + 1)


def part_turns(conversations: DataFrame) -> DataFrame:
    """Turns with one content part each, of the types and call ids of ``tool_turns``, and a made raw span."""
    tools = tool_turns(conversations).select("session_id", "ordinal", "part_type", "call_id")
    rows = turns(conversations).join(tools, ["session_id", "ordinal"])
    text = lambda kind: F.when(F.col("part_type") == kind, F.col("text"))
    part = F.struct(F.col("part_type").alias("type"), text("text").alias("text"), F.lit("run").alias("name"), text("tool_call").alias("arguments"), text("tool_result").alias("output"), F.lit("ok").alias("status"), "call_id")
    span = F.struct((F.col("ordinal") * 10000).alias("char_start"), (F.col("ordinal") * 10000 + F.length("text")).alias("char_end"))
    return rows.select("session_id", (F.col("session_id") * 100 + F.col("ordinal")).alias("turn_id"), "ordinal", "actor_kind", "role", F.array(part).alias("parts"), span.alias("raw_span"))
