"""Snapshot history, change detection and session resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(body: str = "content") -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(F.col(body), F.lit("")), 256))


def history(snapshots: DataFrame) -> DataFrame:
    """Stored snapshots: the first of each content per session, numbered in order of capture; the newest is active.

    Bodies are not carried: the windows sort hashes and ids only.
    """
    slim = snapshots.select("session_id", "captured", content_hash().alias("content_hash"))
    stored = slim.groupBy("session_id", "content_hash").agg(F.min("captured").alias("captured"))
    w = Window.partitionBy("session_id").orderBy("captured")
    numbered = stored.withColumn("snapshot_ordinal", F.row_number().over(w) - 1)
    newest = stored.groupBy("session_id").agg(F.max("captured").alias("newest"))
    return numbered.join(newest, "session_id").select("session_id", "content_hash", "captured", "snapshot_ordinal", (F.col("captured") == F.col("newest")).alias("is_active"))


def visible(rows: DataFrame) -> DataFrame:
    """Active, or not redacted."""
    return rows.where(F.col("is_active") | (F.col("status") != "redacted"))


def changes(stored: DataFrame, derived: DataFrame, key: list[str]) -> DataFrame:
    """new, gone, changed or same for each key, by the digest of all other columns."""
    cols = sorted(c for c in stored.columns if c not in key)
    digest = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    a = stored.select(*key, digest.alias("_a"))
    b = derived.select(*key, digest.alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))


def body_validity(bodies: DataFrame, body: str, kind: str) -> DataFrame:
    """Whether JSON bodies and all lines of JSONL bodies parse; text always does."""
    parsed = lambda x: F.try_parse_json(x).isNotNull()
    filled = F.filter(F.split(F.col(body), "\n"), lambda x: F.trim(x) != "")
    ok = F.when(F.col(kind) == "json", parsed(F.col(body))).when(F.col(kind) == "jsonl", F.forall(filled, parsed)).otherwise(True)
    return bodies.withColumn("valid", F.coalesce(ok, F.lit(False)))


def resolve_sessions(incoming: DataFrame, sessions: DataFrame) -> DataFrame:
    """By harness id, else by locator hash among sessions without one (which then adopt the id)."""
    by_id = sessions.where("harness_session_id IS NOT NULL").select("harness_session_id", F.col("session").alias("by_id"))
    by_place = sessions.where("harness_session_id IS NULL").groupBy("locator_hash").agg(F.min("session").alias("by_place"))
    found = incoming.join(by_id, "harness_session_id", "left").join(by_place, "locator_hash", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_place").isNotNull(), "adopted").otherwise("new")
    return found.withColumn("how", how).withColumn("session", F.coalesce("by_id", "by_place")).drop("by_id", "by_place")


def home_intervals(history: DataFrame, snapshots: DataFrame, intervals: DataFrame) -> DataFrame:
    """A re-imported content belongs to the interval of its first capture."""
    first = history.select("session_id", "content_hash", F.col("captured").alias("first_captured"))
    rows = snapshots.select("session_id", "captured", content_hash().alias("content_hash")).join(first, ["session_id", "content_hash"])
    return rows.join(intervals, ["session_id", "first_captured"], "left")


def rederive(stored: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "session_id") -> DataFrame:
    """Replace the derived rows of changed sessions and keep the rest."""
    ids = changed.select(key).distinct()
    return stored.join(ids, key, "left_anti").unionByName(fresh.join(ids, key, "left_semi"))
