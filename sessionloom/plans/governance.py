"""Decisions on claims and the redirects that they leave, with the SQL of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance
from ..sources import views
from . import events

ACTIONS = ("decay", "merge", "split", "supersede", "promote", "noop")


def claim_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a decision on its user's claim, by numbers. Claims of a workspace are four apart, so targets are too: one, or
    two for a split; some lie beyond the last claim, some are the claim itself."""
    rows = views.table(spark, sf, "events")
    step = lambda n: F.element_at(F.array(*[F.lit(4 * k) for k in (1, 2, -1, 0, 3)]), (F.col("event_id") % n + 1).cast("int"))
    pick = (F.col("event_id") % len(ACTIONS) + 1).cast("int")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), pick)
    one = F.col("user_id") + step(5)
    targets = F.when(action == "split", F.array(one, F.col("user_id") + 4)).when(action.isin("merge", "supersede"), F.array(one))
    return rows.select(
        F.col("event_id").alias("action_id"),
        F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"),
        F.col("user_id").alias("claim_key"),
        action.alias("action"),
        F.col("ts").alias("decided_at"),
        F.when(F.col("event_id") % 4 != 1, F.concat(F.lit("seen in "), F.col("event_type"))).alias("reason"),
        F.when(F.col("event_id") % 9 < 4, F.concat(F.lit("  on "), F.col("event_type"), F.lit(" "))).alias("title"),
        targets.alias("targets"),
    )


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    rows = events.current_claims(spark, sf)
    text = F.concat(F.lit("a claim with a rather long text that has to be cut for its title, number "), F.col("claim_key").cast("string"))
    attributes = F.create_map(F.lit("reviewPinned"), F.col("pinned").cast("string"), F.lit("maintenanceReason"), F.lit("earlier"))
    known = rows.select("workspace_id", "claim_key", "state", text.alias("claim_text"), F.lit("preference").alias("kind"), "confidence", attributes.alias("attributes"))
    return governance.checked(claim_actions(spark, sf), known)


def claim_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A row per action: its event with attributes as sorted text, or the code of its refusal."""
    rows = _checked(spark, sf)
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    accepted = governance.decision_events(rows).select("action_id", "event_type", "evidence_type", "kind", "confidence", "quote", F.array_join(pairs, ";").alias("attributes"), F.lit(None).cast("string").alias("code"))
    return accepted.unionByName(rows.where("code IS NOT NULL").select("action_id", "code"), allowMissingColumns=True)


def claim_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """A row per redirected claim (live_key, hops, live_targets) and per refused redirect (action_id, code)."""
    led, refused = governance.redirects(_checked(spark, sf))
    ends = led.withColumn("live_targets", F.array_join(F.col("live_targets").cast("array<string>"), ","))
    return ends.unionByName(refused, allowMissingColumns=True)


ORACLES = {
    "claim_decisions": f"""WITH RECURSIVE {events._CLAIMS},
      a AS (SELECT event_id AS action_id, 'w' || (user_id % 4) AS workspace_id, user_id AS claim_key, ['decay', 'merge', 'split', 'supersede', 'promote', 'noop'][event_id % 6 + 1] AS action, ts,
        CASE WHEN event_id % 4 <> 1 THEN 'seen in ' || event_type END AS reason, CASE WHEN event_id % 9 < 4 THEN 'on ' || event_type END AS title, user_id + [4, 8, -4, 0, 12][event_id % 5 + 1] AS t FROM events),
      b AS (SELECT *, CASE WHEN action IN ('merge', 'supersede') THEN [t] WHEN action = 'split' AND t <> claim_key + 4 THEN [t, claim_key + 4] WHEN action = 'split' THEN [t] ELSE [] END AS ts_,
        MAP {{'decay': 'decayed', 'merge': 'merged', 'split': 'split', 'supersede': 'superseded', 'promote': 'promoted'}}[action] AS ev FROM a),
      m AS (SELECT DISTINCT action_id FROM (SELECT action_id, workspace_id, unnest(ts_) AS t FROM b) WHERE (workspace_id, t) NOT IN (SELECT (workspace_id, claim_key) FROM cc)),
      c AS (SELECT b.*, cc.state, cc.confidence, cc.pinned, CASE WHEN cc.state IS NULL THEN 'unknown_claim' WHEN ev IS NULL THEN 'unknown_action' WHEN action = 'promote' AND cc.state IN ('rejected', 'superseded') THEN 'terminal_claim'
        WHEN list_contains(ts_, b.claim_key) THEN 'self_target' WHEN b.action_id IN (SELECT action_id FROM m) THEN 'unknown_target' END AS code FROM b LEFT JOIN cc USING (workspace_id, claim_key)),
      d AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS t0, coalesce(title, substr('a claim with a rather long text that has to be cut for its title, number ' || claim_key, 1, 69) || '...') AS name FROM c)
      SELECT action_id, code, CASE WHEN code IS NULL THEN ev END AS event_type, CASE WHEN code IS NULL THEN confidence END AS confidence,
        CASE WHEN code IS NOT NULL THEN NULL WHEN action = 'promote' THEN 'claim.promotion' ELSE 'claim.maintenance' END AS evidence_type,
        CASE WHEN code IS NOT NULL THEN NULL WHEN action = 'promote' THEN 'decision' ELSE 'preference' END AS kind,
        CASE WHEN code IS NOT NULL THEN NULL WHEN action = 'promote' THEN 'Promoted to decision record: ' || name ELSE 'Control-plane maintenance action: ' || action END AS quote,
        CASE WHEN code IS NOT NULL THEN NULL WHEN action = 'promote' THEN 'adrPromoted=true;adrPromotedAt=' || t0 || ';adrTitle=' || name || ';maintenanceReason=earlier;reviewPinned=' || pinned
          ELSE 'maintenanceLastAction=' || ev || ';maintenanceLastAt=' || t0 || ';maintenanceReason=' || coalesce(reason, 'earlier') || CASE WHEN len(ts_) > 0 THEN ';maintenanceTargetClaimKeys=' || array_to_string(ts_, ',') ELSE '' END || ';reviewPinned=' || pinned END AS attributes FROM d""",
}

QUERIES = {"claim_decisions": claim_decisions, "claim_redirects": claim_redirects}
