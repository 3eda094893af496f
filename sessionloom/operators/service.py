"""Look-ups and checks of the service's tables: identities, activation, bindings, evidence, impact, backfill, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledger import BOUNDARY, recent

ACTIVATION = ("SessionStart", "UserPromptSubmit")


def identities(ids: DataFrame, sessions: DataFrame, records: DataFrame) -> DataFrame:
    """(workspace_id, id, session_id, record_id) of ids that name a session or a record of the same workspace.

    An id that names both is the session's, and has no record then. Ids that name neither are left out; repeated ids
    and null ids give one row and none.
    """
    asked = ids.select("workspace_id", "id").distinct()
    own = sessions.select("workspace_id", F.col("session_id").cast("string").alias("id"), "session_id", F.lit(None).cast(records.schema["record_id"].dataType).alias("record_id"), F.lit(0).alias("place"))
    held = records.select("workspace_id", F.col("record_id").cast("string").alias("id"), "session_id", "record_id", F.lit(1).alias("place"))
    found = own.unionByName(held).join(asked, ["workspace_id", "id"], "left_semi")
    best = found.groupBy("workspace_id", "id").agg(F.min(F.struct("place", "session_id", "record_id")).alias("b"))
    return best.select("workspace_id", "id", "b.session_id", "b.record_id")


def activation_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest start and prompt events of each binding (workspace, source)."""
    keyed = events.where(F.col("hook").isin(*ACTIVATION)).withColumn("binding", F.struct("workspace_id", "source_id"))
    return recent(keyed, "binding", [F.col("occurred_at").desc(), F.col("raw_event_id").desc()], limit).drop("binding")


def listing(workspaces: DataFrame, bindings: DataFrame) -> DataFrame:
    """Workspaces in the order of their handles, each with its bindings in the order of type and address; a workspace
    without bindings has one row with nulls."""
    rows = workspaces.join(bindings, "workspace_id", "left")
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy("binding_type", "uri"))
    return rows.withColumn("place", F.when(F.col("binding_type").isNotNull(), place)).orderBy("handle", "place")


def evidence_codes(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence with ``code``: its event is missing, is of another workspace, or has other source ids; null if sound."""
    sides = ["source_id", "external_event_id"]
    known = events.select("raw_event_id", F.col("workspace_id").alias("_workspace"), F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in sides])
    rows = evidence.join(known, "raw_event_id", "left")
    other = ~F.col(sides[0]).eqNullSafe(F.col(f"_{sides[0]}")) | ~F.col(sides[1]).eqNullSafe(F.col(f"_{sides[1]}"))
    code = F.when(F.col("_known").isNull(), "missing_event").when(~F.col("workspace_id").eqNullSafe(F.col("_workspace")), "foreign_workspace").when(other, "source_mismatch")
    return rows.withColumn("code", code).drop("_known", "_workspace", *[f"_{c}" for c in sides])


def impact(counts: DataFrame, tables: list[str]) -> DataFrame:
    """Counts (table, session_id, n) of an erasure as one row per session with a column per table, 0 where none."""
    sums = [F.coalesce(F.sum(F.when(F.col("table") == t, F.col("n"))), F.lit(0)).alias(t) for t in tables]
    return counts.groupBy("session_id").agg(*sums, F.sum("n").alias("total"))


def backfill(records: DataFrame, events: DataFrame, triggers: DataFrame, queued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History of a store without a queue: captured records become derived, and boundary events that triggered no
    interval (``triggers``: workspace_id, raw_event_id) are queued unless they are. Running it again changes nothing."""
    derived = records.withColumn("status", F.when(F.col("status") == "captured", "derived").otherwise(F.col("status")))
    fresh = events.where(F.col("hook").isin(*BOUNDARY)).select("workspace_id", "raw_event_id").distinct()
    fresh = fresh.join(triggers, ["workspace_id", "raw_event_id"], "left_anti").join(queued, "raw_event_id", "left_anti")
    return derived, queued.select("workspace_id", "raw_event_id", "status").unionByName(fresh.withColumn("status", F.lit("pending")))


def settle(queue: DataFrame, applied: DataFrame) -> DataFrame:
    """Queue entries whose event was applied (``applied``: raw_event_id) become settled, each once; others stay."""
    done = applied.select("raw_event_id", F.lit(True).alias("_done")).distinct()
    return queue.join(done, "raw_event_id", "left").withColumn("status", F.when(F.col("_done") & (F.col("status") == "pending"), "settled").otherwise(F.col("status"))).drop("_done")
