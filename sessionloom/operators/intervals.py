"""Activity intervals: sessionisation with stop, clear and idle boundaries, as plain windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDLE_MINUTES = 30


def first_deliveries(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """``events`` without redelivered ones: of each event of a session the first to arrive, since what was applied once
    changes nothing when it comes again. A combined aggregate, so an event sent very often is one row a task."""
    rest = [c for c in events.columns if c not in ("session_id", "raw_event_id")]
    kept = events.groupBy("session_id", "raw_event_id").agg(F.min_by(F.struct(*rest), arrival).alias("_r"))
    return kept.select("session_id", "raw_event_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def labelled(events: DataFrame, order: list[str], idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """``events`` (session_id, hook, start_source, occurred_at) with ``opens``, ``stops`` and ``interval_ordinal``.

    A stop that arrives after the idle time opens an interval that stays active, so it takes over the stop state of the
    row before it.
    """
    w = Window.partitionBy("session_id").orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("before", F.lag("occurred_at").over(w))
    rows = rows.withColumn("idle", F.coalesce(F.col("occurred_at") > F.col("before") + F.expr(f"INTERVAL {idle_minutes} MINUTES"), F.lit(False)))
    stop = F.col("hook") == "Stop"
    rows = rows.withColumn("stops", F.coalesce(F.last(F.when(~(stop & F.col("idle")), stop), ignorenulls=True).over(running), F.lit(False)))
    rows = rows.withColumn("clears", (F.col("hook") == "SessionStart") & F.coalesce(F.col("start_source").isin("clear", "compact"), F.lit(False)))
    opens = F.col("before").isNull() | F.coalesce(F.lag("stops").over(w), F.lit(False)) | F.col("clears") | F.col("idle")
    rows = rows.withColumn("opens", opens)
    return rows.withColumn("interval_ordinal", (F.sum(F.col("opens").cast("int")).over(running) - 1).cast("long"))


def intervals(events: DataFrame, order: list[str], idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """One row per interval: start, end, event count, status and the reason it was settled for."""
    rows = labelled(events, order, idle_minutes)
    w = Window.partitionBy("session_id").orderBy(*order)
    rows = rows.withColumn("next_at", F.lead("occurred_at").over(w)).withColumn("next_clears", F.lead("clears").over(w)).withColumn("next_opens", F.lead("opens").over(w))
    # the interval's last row decides how it ended
    last = F.coalesce("next_opens", F.lit(True))
    reason = F.when(F.col("stops"), "stop_event").when(F.col("next_at").isNull(), None).when(F.col("next_clears"), "clear_context").otherwise("idle_timeout")
    idle_end = F.col("occurred_at") + F.expr(f"INTERVAL {idle_minutes} MINUTES")
    end = F.when(F.col("stops"), F.col("occurred_at")).when(F.col("next_at").isNull(), None).when(F.col("next_clears"), F.col("next_at")).otherwise(idle_end)
    out = rows.groupBy("session_id", "interval_ordinal").agg(
        F.min_by("occurred_at", F.struct(*order)).alias("started_at"),
        F.count("*").alias("n_events"),
        F.max(F.when(last, reason)).alias("reason"),
        F.max(F.when(last, end)).alias("ended_at"),
    )
    return out.withColumn("status", F.when(F.col("reason").isNull(), "active").otherwise("settled"))


def active(table: DataFrame) -> DataFrame:
    """The newest active interval of each session."""
    return table.where("status = 'active'").groupBy("session_id").agg(F.max("interval_ordinal").alias("interval_ordinal"))


def idle_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The idle-only variant by Spark's session window."""
    spans = events.groupBy("session_id", F.session_window("occurred_at", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return spans.select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n_events")
