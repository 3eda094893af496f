"""Hard redaction of whole sessions: bodies, events, what refers to events, and claims that rest on them.

1. The newest body of a session is redacted to a new active snapshot and all older bodies are emptied.
2. Events of the session are rewritten: texts, and JSON with its keys. An external or source id that holds a
   pattern is replaced whole by one made of the event's own id, which no pattern can have touched.
3. Whatever names an event by its external id follows by a join with the list of replaced ids, so references stay consistent.
   New ids come from event ids alone, so one pass reaches the fixed point: no reference changes an id again.
4. Claims with a rewritten event among their evidence are invalidated, and their events are marked.

A session without any hit, or whose redacted body has the hash of a body it had before, is left as it is and reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import claims as claim_ops
from .patterns import redactor

EVENT_TEXTS, EVENT_JSON = ("actor_id", "session_ref", "trace_id"), ("payload", "provenance")


def rewrite_events(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """``events`` (raw_event_id, external_event_id, source_id and any of EVENT_TEXTS and EVENT_JSON) rewritten, with
    ``hits`` and the ids before (``old_external_id``, ``old_source_id``)."""
    text, tree = redactor(patterns)
    names = [c for c in (*EVENT_TEXTS, *EVENT_JSON, "external_event_id", "source_id") if c in events.columns]
    rows = events.withColumns({f"_{c}": (tree if c in EVENT_JSON else text)(F.col(c)) for c in names})
    hits = sum((F.col(f"_{c}.n") for c in names), F.lit(0))
    rows = rows.withColumns({"hits": hits.cast("long"), "old_external_id": F.col("external_event_id"), "old_source_id": F.col("source_id")})
    own = lambda c, end: F.when(F.col(f"_{c}.n") > 0, F.concat(F.lit("redacted:"), F.col("raw_event_id").cast("string"), F.lit(f":{end}"))).otherwise(F.col(c))
    new = {c: F.when(F.col("hits") > 0, F.col(f"_{c}.text")).otherwise(F.col(c)) for c in names if c not in ("external_event_id", "source_id")}
    return rows.withColumns(new | {"external_event_id": own("external_event_id", "external-event"), "source_id": own("source_id", "source")}).drop(*[f"_{c}" for c in names])


def follow(references: DataFrame, rewritten: DataFrame, column: str) -> DataFrame:
    """``references`` whose ``column`` names events by external id, under their new ids."""
    moved = rewritten.where("old_external_id <> external_event_id").select(F.col("old_external_id").alias(column), F.col("external_event_id").alias("_new"))
    return references.join(moved, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(references.columns)


def redact_sessions(tables: dict[str, DataFrame], patterns: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (snapshots, events, references, claim_events, claims) after the redaction of the chosen sessions, and ``errors``.

    snapshots: session_id, captured, content; events: see :func:`rewrite_events`, with session_id; references: external_id
    and any columns; claim_events and claims: see ``claims.invalidate``.
    """
    text, _ = redactor(patterns)
    chosen = chosen.select("session_id").distinct()
    shots = tables["snapshots"].join(chosen, "session_id", "left_semi")
    newest = shots.groupBy("session_id").agg(F.max("captured").alias("captured"))
    last = shots.join(newest, ["session_id", "captured"]).withColumn("_r", text(F.col("content")))
    last = last.select("session_id", "captured", F.col("_r.text").alias("content"), F.coalesce("_r.n", F.lit(0)).alias("n"))
    events = rewrite_events(tables["events"].join(chosen, "session_id", "left_semi"), patterns)
    told = events.groupBy("session_id").agg(F.sum("hits").alias("in_events"))
    # the bodies' hashes of a session are compared by an equi-join, so no session's history is gathered
    repeated = last.where("n > 0").select("session_id", F.sha2("content", 256).alias("h")).join(shots.select("session_id", F.sha2("content", 256).alias("h")).distinct(), ["session_id", "h"], "left_semi").select("session_id", F.lit(True).alias("same"))
    state = chosen.join(last.select("session_id", "n"), "session_id", "left").join(told, "session_id", "left").join(repeated, "session_id", "left")
    code = F.when(F.coalesce("n", F.lit(0)) + F.coalesce("in_events", F.lit(0)) == 0, "no_match").when(F.col("same"), "repeated_hash")
    state = state.select("session_id", code.alias("code"), (F.coalesce("n", F.lit(0)) > 0).alias("body_hit"))
    errors = state.where("code IS NOT NULL").select("session_id", "code")
    done = state.where("code IS NULL").select("session_id", "body_hit")

    hit = done.where("body_hit").select("session_id", F.lit(True).alias("_hit"))
    old = tables["snapshots"].join(hit, "session_id", "left").join(newest.withColumnRenamed("captured", "_newest"), "session_id", "left")
    gone = F.coalesce("_hit", F.lit(False))
    old = old.select("session_id", "captured", F.when(gone, None).otherwise(F.col("content")).alias("content"), F.when(gone, "redacted").otherwise("captured").alias("status"))
    added = last.join(hit, "session_id").select("session_id", (F.col("captured") + 1).alias("captured"), "content", F.lit("redacted").alias("status"))
    snapshots = old.unionByName(added)

    rewritten = events.where("hits > 0").join(done, "session_id", "left_semi")
    kept = tables["events"].join(rewritten.select("raw_event_id"), "raw_event_id", "left_anti")
    names = tables["events"].columns
    after = kept.withColumn("hits", F.lit(0).cast("long")).unionByName(rewritten.select(*names, "hits"))
    left, marked = claim_ops.invalidate(tables["claims"], tables["claim_events"], rewritten)
    return {"snapshots": snapshots, "events": after, "references": follow(tables["references"], rewritten, "external_id"), "claims": left, "claim_events": marked, "errors": errors}
