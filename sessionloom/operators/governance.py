"""Decisions on claims: maintenance and promotion with reasons, targets and titles, and the redirects that they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import default_title
from .graph import stored

#: The event of each action, and the kinds of evidence.
MAINTENANCE = {"decay": "decayed", "merge": "merged", "split": "split", "supersede": "superseded"}
PROMOTION = {"promote": "promoted"}
#: Actions whose targets take the place of their claim.
REDIRECTING = ("merge", "split", "supersede")
TERMINAL = ("rejected", "superseded")


def _event_of(action: Column) -> Column:
    names = MAINTENANCE | PROMOTION
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), action)


def iso_time(at: Column) -> Column:
    """A timestamp as ISO text with milliseconds, in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def promotion_title(title: Column, claim_text: Column) -> Column:
    """The given title without the white space around it; where nothing is left, the claim's text cut by ``default_title``."""
    given = F.regexp_replace(title, r"^\s+|\s+$", "")
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(default_title(claim_text))


def checked(actions: DataFrame, claims: DataFrame) -> DataFrame:
    """``actions`` (action_id, workspace_id, claim_key, action, decided_at, reason, title, targets) with the claim's state, text,
    kind, confidence and attributes, ``event_type``, and ``code``: why the action is refused, or null.

    A claim or target that the workspace lacks, an unknown action, a missing time, the promotion of a terminal claim and a
    target that is the claim itself are refused. Targets are found by one join of their distinct keys; null targets don't
    count, and an action without targets redirects nothing.
    """
    known = claims.select("workspace_id", "claim_key", "state", "claim_text", "kind", "confidence", "attributes")
    rows = actions.withColumn("targets", F.array_distinct(F.array_compact(F.coalesce("targets", F.array().cast(actions.schema["targets"].dataType)))))
    named = rows.select("action_id", "workspace_id", F.explode("targets").alias("target"))
    there = claims.select("workspace_id", F.col("claim_key").alias("target"))
    unknown = named.join(there, ["workspace_id", "target"], "left_anti").select("action_id").distinct().withColumn("unknown", F.lit(True))
    found = rows.join(known, ["workspace_id", "claim_key"], "left").join(unknown, "action_id", "left")
    event = _event_of(F.col("action"))
    code = (
        F.when(F.col("state").isNull(), "unknown_claim")
        .when(event.isNull(), "unknown_action")
        .when(F.col("decided_at").isNull(), "bad_time")
        .when(F.col("action").isin(*PROMOTION) & F.col("state").isin(*TERMINAL), "terminal_claim")
        .when(F.array_contains("targets", F.col("claim_key")), "self_target")
        .when(F.col("unknown"), "unknown_target")
    )
    return found.withColumns({"event_type": event, "code": code}).drop("unknown")


def decision_events(rows: DataFrame) -> DataFrame:
    """The claim events of accepted ``checked`` actions, with their evidence and the claim's attributes after them.

    Maintenance keeps the claim's kind, and a reason or targets left out keep those of an earlier decision; a promotion makes
    the claim a decision record. Values of attributes are text, targets one text with commas.
    """
    at = iso_time(F.col("decided_at"))
    promoted = F.col("action").isin(*PROMOTION)
    title = promotion_title(F.col("title"), F.col("claim_text"))
    adr = F.create_map(F.lit("adrPromoted"), F.lit("true"), F.lit("adrPromotedAt"), at, F.lit("adrTitle"), title)
    targets = F.when(F.size("targets") > 0, F.array_join(F.col("targets").cast("array<string>"), ","))
    care = F.create_map(F.lit("maintenanceLastAction"), F.col("event_type"), F.lit("maintenanceLastAt"), at, F.lit("maintenanceReason"), F.col("reason"), F.lit("maintenanceTargetClaimKeys"), targets)
    new = F.map_filter(F.when(promoted, adr).otherwise(care), lambda k, v: v.isNotNull())
    old = F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    quote = F.when(promoted, F.concat(F.lit("Promoted to decision record: "), title)).otherwise(F.concat(F.lit("Control-plane maintenance action: "), F.col("action")))
    return rows.where("code IS NULL").select(
        "action_id",
        "workspace_id",
        "claim_key",
        "event_type",
        F.col("decided_at").alias("occurred_at"),
        F.when(promoted, "claim.promotion").otherwise("claim.maintenance").alias("evidence_type"),
        F.when(promoted, "decision").otherwise(F.col("kind")).alias("kind"),
        "confidence",
        quote.alias("quote"),
        F.col("state").alias("previous_state"),
        merged.alias("attributes"),
    )


def follow(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of the chains of ``pointers`` (node, next, decision), one row a node, and the newest decision of every cycle.

    The first result is (node, at, hops) of the nodes that come to an end. Pointers are doubled: a round joins each row that has not
    come to an end with the row of the node that it has reached, so a chain takes a logarithmic number of rounds. Rows that still go on after
    as many steps as there are pointers are on a cycle or lead to one; what they have reached are the nodes of cycles, and each of
    those has walked its whole cycle, whose newest decision it carries.
    """
    far = stored(pointers.select("node", F.col("next").alias("at"), F.lit(1).cast("long").alias("hops"), F.col("decision").alias("newest")), "pointers")
    count, steps = far.count(), 1
    ended = None
    while True:
        going = far.join(far.select(F.col("node").alias("at")), "at", "left_semi").select("node", "at", "hops", "newest")
        done = far.join(far.select(F.col("node").alias("at")), "at", "left_anti").select("node", "at", "hops")
        if steps >= max(count, 1) or going.isEmpty():
            break
        further = far.select(F.col("node").alias("at"), F.col("at").alias("end"), F.col("hops").alias("more"), F.col("newest").alias("other"))
        moved = far.join(further, "at", "left")
        far = stored(moved.select("node", F.coalesce("end", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.greatest("newest", "other").alias("newest")), "pointers")
        steps *= 2
    ended = done
    on_cycle = going.select(F.col("at").alias("node")).distinct()
    return ended, far.join(on_cycle, "node", "left_semi").select(F.col("newest").alias("decision")).distinct()


def redirects(rows: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Where redirected claims lead, and the redirecting actions that are refused.

    Of the accepted ``checked`` actions that merge, split or supersede a claim and name targets, taken by (decided_at, action_id), a
    claim's first one that closes no cycle stands; the claim then leads to the first target, its heir. Later ones are
    refused as ``redirected_claim``, one whose heir already leads back to the claim as ``cyclic_target``. The rows are those of taking
    the actions one after the other: an action is refused only if it is the newest of a cycle of first actions, and with it go the
    later ones of that claim to that heir. Each turn of the loop refuses at least one heir of a claim for each cycle; it is
    an error if ``rounds`` turns leave a cycle.

    Returns (workspace_id, claim_key, live_key, hops, live_targets: sorted ends of all targets) for each redirected claim, and
    (action_id, workspace_id, claim_key, code).
    """
    order = F.struct("decided_at", "action_id")
    moves = rows.where(F.col("code").isNull() & F.col("action").isin(*REDIRECTING) & (F.size("targets") > 0))
    node = lambda key: F.struct(F.col("workspace_id"), F.col(key).alias("claim_key"))
    moves = moves.withColumn("heir", F.col("targets")[0]).select("action_id", "workspace_id", "claim_key", "targets", node("claim_key").alias("node"), node("heir").alias("next"), order.alias("decision"))
    moves = stored(moves, "moves")
    banned = None  # (node, next) whose actions close a cycle
    for _ in range(rounds):
        left = moves if banned is None else moves.join(banned, ["node", "next"], "left_anti")
        first = stored(left.groupBy("node").agg(F.min_by(F.struct("next", "decision", "targets"), "decision").alias("f")).select("node", "f.*"), "first")
        ends, closing = follow(first)
        closing = stored(closing.join(first.select("node", "next", "decision"), "decision").select("node", "next"), "closing")
        if closing.isEmpty():
            break
        banned = closing if banned is None else banned.unionByName(closing)
    else:
        raise RuntimeError(f"redirects still hold a cycle after {rounds} rounds")

    ends = stored(ends, "ends")
    shares = first.select("node", "node.workspace_id", F.explode("targets").alias("target")).select("node", "target", node("target").alias("at"))
    lead = ends.select(F.col("node").alias("at"), F.col("at.claim_key").alias("end"))
    live = shares.join(lead, "at", "left").groupBy("node").agg(F.array_sort(F.collect_set(F.coalesce("end", "target"))).alias("live_targets"))
    led = ends.join(live, "node").select("node.workspace_id", "node.claim_key", F.col("at.claim_key").alias("live_key"), "hops", "live_targets")

    stands = first.select("node", F.col("decision").alias("stands"))
    late = moves.join(stands, "node", "left").where("stands IS NULL OR decision <> stands")
    cyclic = F.lit(False)
    if banned is not None:
        late = late.join(banned.distinct().withColumn("banned", F.lit(True)), ["node", "next"], "left")
        # an action after the one that stands meets a claim that is redirected already, whatever its heir
        cyclic = F.coalesce("banned", F.lit(False)) & (F.col("stands").isNull() | (F.col("decision") < F.col("stands")))
    refused = late.select("action_id", "workspace_id", "claim_key", F.when(cyclic, "cyclic_target").otherwise("redirected_claim").alias("code"))
    return led, refused
