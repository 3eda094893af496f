"""Claims: confidence scores, the fold of claim events to current claims, and review actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds

# Precedence of states and the parts of the score.
PRECEDENCE = {"rejected": 4, "superseded": 3, "contradicted": 2, "supported": 1}
STATE_OF = {"extracted": "candidate", "supported": "supported", "contradicted": "contradicted", "promoted": "supported", "rejected": "rejected", "superseded": "superseded", "decayed": "decayed", "merged": "superseded", "split": "superseded"}
ACTOR = {"human": 0.08, "control-plane": 0.08, "codex": 0.01, "claude": 0.01}
AGAINST = {"contradicted": 0.22, "decayed": 0.45, "merged": 0.5, "split": 0.5, "superseded": 0.5, "rejected": 0.35}
SOURCE = {"git": 0.03, "codex": 0.01, "claude": 0.01}
#: Events that change attributes only, with the attribute and its new value.
FLAGS = {"pinned": ("pinned", True), "unpinned": ("pinned", False), "watched": ("watched", True), "unwatched": ("watched", False)}
#: The kinds of events that a decision of the given kind of evidence may force.
GOVERNED = {"claim.review": ("supported", "rejected"), "claim.promotion": ("promoted",), "claim.maintenance": ("decayed", "merged", "split", "superseded")}
#: Only these count as recurrence.
RECURRING = ("extracted", "supported")


def _pick(col: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def state_of(event_type: Column) -> Column:
    """The state that an event puts its claim in; null for events that change attributes only."""
    return _pick(event_type, STATE_OF, None)


def prior_counts(events: DataFrame) -> DataFrame:
    """Counts of recurring events and contradictions of the claim before each event, in order of arrival.

    The rows also carry ``_run``, the run of sorted rows (``folds.runs``) that an event lies in.
    """
    cut = events if "_run" in events.columns else folds.runs(events)
    return folds.running_counts(cut, {"prior_events": F.col("event_type").isin(*RECURRING), "prior_against": F.col("event_type") == "contradicted"})


def confidence(*, base, event_type, kind, actor, source, trusted, own_source, age_days, prior_events, prior_against) -> Column:
    """The score: a sum of parts, rounded to 4 places and held to [0, 1]."""
    own = source == own_source
    against = -F.least(F.lit(0.16), F.lit(0.08) * prior_against) - _pick(event_type, AGAINST, 0.0)
    explicit = F.when(event_type == "promoted", 0.12).when((event_type == "supported") & own, 0.08).when((event_type == "extracted") & (kind == "decision"), 0.03).when((event_type == "extracted") & (kind == "preference"), 0.02).otherwise(0.0)
    human = F.when(own, _pick(event_type, {"promoted": 0.2, "supported": 0.15, "rejected": -0.35}, 0.0)).otherwise(0.0)
    recurrence = F.least(F.lit(0.12), F.lit(0.04) * prior_events)
    recency = F.when(age_days <= 7, 0.03).when(age_days <= 30, 0.01).when(age_days <= 90, 0.0).otherwise(-0.08)
    origin = F.when(trusted, 0.08).otherwise(0.0) + F.when(own, 0.05).otherwise(_pick(source, SOURCE, 0.0))
    total = base + _pick(actor, ACTOR, 0.0) + against + explicit + human + recurrence + recency + origin
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 4)))


def first_per_key(events: DataFrame) -> DataFrame:
    """Redelivered events once: the first of (workspace, type, claim, raw event)."""
    key = ["workspace_id", "event_type", "claim_key", "raw_event_id"]
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def governed(event_type: Column, evidence_type: Column) -> Column:
    """Whether an event is a decision that advances its claim whatever the precedence: by its type and its evidence's."""
    hit = F.lit(False)
    for evidence, types in GOVERNED.items():
        hit = hit | (event_type.isin(*types) & (evidence_type == evidence))
    return F.coalesce(hit, F.lit(False))


def _flag(name: str) -> str:
    """SQL of an attribute after event e: what the event sets, else what it was."""
    set_by = " ".join(f"WHEN e.event_type = '{k}' THEN {str(v).lower()}" for k, (flag, v) in FLAGS.items() if flag == name)
    return f"CASE {set_by} ELSE a.{name} END"


def _fold() -> str:
    """SQL of a run's fold from the state ``before`` it; attributes that the run does not set stay null, n counts its advances."""
    kind = f"STRUCT<at: {folds.PLACE}, pinned: BOOLEAN, watched: BOOLEAN, review: STRING, n: BIGINT>"
    known = ", ".join(f"'{k}'" for k in FLAGS)
    flagged = f"named_struct('at', a.at, 'pinned', {_flag('pinned')}, 'watched', {_flag('watched')}, 'review', e.event_type, 'n', a.n)"
    advanced = f"named_struct('at', {folds.OF_EVENT}, 'pinned', a.pinned, 'watched', a.watched, 'review', a.review, 'n', a.n + 1L)"
    advances = "a.at IS NULL OR (a.at.micros <= e.micros AND (e.governed OR e.rank >= a.at.rank))"
    start = f"CAST(named_struct('at', before, 'pinned', null, 'watched', null, 'review', null, 'n', 0L) AS {kind})"
    return f"""aggregate(log, {start}, (a, e) -> CAST(CASE
      WHEN e.state IS NULL THEN if(a.at IS NULL OR e.event_type NOT IN ({known}), a, CAST({flagged} AS {kind}))
      WHEN {advances} THEN CAST({advanced} AS {kind}) ELSE a END AS {kind}))"""


def project(events: DataFrame) -> DataFrame:
    """Fold each claim's events, in order of arrival, to its current state.

    Events that name a state advance the claim when they are no older and of no lower precedence (a candidate has
    the lowest); ``governed`` ones advance it whatever the precedence. The events of ``FLAGS`` change attributes of a
    claim that is there already; attributes outlive every advance. Events carry (workspace_id, claim_key, seq,
    event_type, occurred_at, confidence) and may carry governed, and the ``_run`` of ``prior_counts``. Events without a
    time, or with a seq that another of the claim has too, have no defined place.

    A claim of any length is folded run by run: the runs' summaries give the state before each, then every run is
    folded by itself. Only runs that another run of the claim follows are summarised.
    """
    if "governed" not in events.columns:
        events = events.withColumn("governed", F.lit(False))
    if "_run" not in events.columns:
        events = folds.runs(events)
    state = state_of(F.col("event_type"))
    coded = events.withColumns({"state": state, "rank": _pick(state, PRECEDENCE, 0), "micros": F.unix_micros(F.col("occurred_at").cast("timestamp")), "governed": F.coalesce("governed", F.lit(False))})
    event = F.struct("seq", "event_type", "state", "rank", "micros", "confidence", "governed")
    packed = coded.groupBy(*folds.KEY, "_run").agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = events.groupBy(*folds.KEY).agg(F.min("_run").alias("_first"), F.max("_run").alias("_last")).where("_first < _last")
    long = [F.col(c).eqNullSafe(F.col(f"_{c}_l")) for c in folds.KEY]
    split = packed.join(last.select(*[F.col(c).alias(f"_{c}_l") for c in folds.KEY], "_last"), long).drop(*[f"_{c}_l" for c in folds.KEY])
    steps = F.when(F.col("_run") < F.col("_last"), F.expr(folds.summary("log"))).otherwise(F.expr(f"CAST(array() AS {folds.STEPS})"))
    before = folds.states_before(split.select(*folds.KEY, "_run", steps.alias("steps")))
    folded = folds.same_run(packed, before, "left").withColumn("c", F.expr(_fold()))
    latest = lambda name: F.max_by(F.col(f"c.{name}"), F.when(F.col(f"c.{name}").isNotNull(), F.col("_run")))
    whole = folded.groupBy(*folds.KEY).agg(latest("at").alias("at"), latest("pinned").alias("pinned"), latest("watched").alias("watched"), latest("review").alias("last_review"), F.sum("c.n").alias("n_advances")).where("at IS NOT NULL")
    observed = F.timestamp_micros("at.micros").cast("timestamp_ntz").alias("observed_at")
    held = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("pinned", "watched")]
    return whole.select(*folds.KEY, "at.state", observed, "at.confidence", F.col("at.seq").alias("latest_seq"), *held, "last_review", "n_advances")


def live(claims: DataFrame, limit: int = 8) -> DataFrame:
    """Per workspace the most confident claims that are neither rejected nor superseded."""
    w = Window.partitionBy("workspace_id").orderBy(F.col("confidence").desc(), F.col("observed_at").desc(), "claim_key")
    return claims.where("state NOT IN ('rejected', 'superseded')").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def review(actions: DataFrame, claims: DataFrame) -> DataFrame:
    """Review and maintenance actions to claim events; terminal claims refuse promotion."""
    event = _pick(F.col("action"), {"accept": "supported", "reject": "rejected", "pin": "pinned", "unpin": "unpinned", "watch": "watched", "unwatch": "unwatched", "promote": "promoted", "decay": "decayed", "merge": "merged", "split": "split", "supersede": "superseded"}, None)
    found = actions.join(claims.select("workspace_id", "claim_key", "state"), ["workspace_id", "claim_key"], "left")
    refused = F.when(F.col("state").isNull(), "unknown_claim").when((F.col("action") == "promote") & F.col("state").isin("rejected", "superseded"), "terminal_claim").when(event.isNull(), "unknown_action")
    return found.select("workspace_id", "claim_key", "action", event.alias("event_type"), refused.alias("refused"))


def default_title(text: Column) -> Column:
    return F.when(F.length(text) > 72, F.concat(F.substring(text, 1, 69), F.lit("..."))).otherwise(text)


def keep_review_attributes(old: Column, new: Column) -> Column:
    """New attributes win, but review and decision attributes of the old ones survive."""
    return F.map_concat(F.map_filter(old, lambda k, v: k.startswith("review") | k.startswith("adr")), new)


def invalidate(claims: DataFrame, events: DataFrame, redacted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims without those whose evidence was redacted, and the events with tombstones in place of their text."""
    hit = events.join(redacted.select("raw_event_id").distinct(), "raw_event_id", "left_semi")
    gone = claims.join(hit.select("workspace_id", "claim_key").distinct(), ["workspace_id", "claim_key"], "left_anti")
    marked = events.join(redacted.select("raw_event_id", F.lit(True).alias("_hit")).distinct(), "raw_event_id", "left")
    return gone, marked.withColumn("redacted", F.coalesce("_hit", F.lit(False))).drop("_hit")
