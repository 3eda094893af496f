"""Queries over the event ledger, activity intervals and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, intervals, ledger
from ..sources import views

AS_OF = "2024-02-01 00:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return views.raw_events(views.table(spark, sf, "events"))


def ledger_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh event is delivered twice; ids divisible by eleven are in the ledger already."""
    events = _events(spark, sf).withColumn("arrival", F.col("raw_event_id") * 2)
    again = events.where("raw_event_id % 7 = 0").withColumn("arrival", F.col("raw_event_id") * 2 + 1)
    added = ledger.append(events.where("raw_event_id % 11 = 0"), events.unionByName(again), "arrival", events.select("workspace_id", "source_type").distinct())
    return added.select("workspace_id", "source_id", "external_event_id", "session_id", "event_type", "arrival")


def ingest_acks(spark: SparkSession, sf: str) -> DataFrame:
    """The batch holds every fifth event twice, each thirteenth without id and negative values as errors."""
    events = _events(spark, sf)
    items = events.withColumn("item", F.col("raw_event_id") * 2).withColumn("external_event_id", F.when(F.col("raw_event_id") % 13 != 0, F.col("external_event_id")))
    again = events.where("raw_event_id % 5 = 0").withColumn("item", F.col("raw_event_id") * 2 + 1)
    batch = items.unionByName(again).withColumn("value", F.when(F.col("raw_event_id") % 17 == 0, -F.col("value")).otherwise(F.col("value")))
    return ledger.ingest_acks(batch, events.where("raw_event_id % 11 = 0"))


def external_event_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Hook records rebuilt from events, with deterministic external ids."""
    hook = F.struct(
        F.concat(F.lit("/w/"), (F.col("user_id") % 4).cast("string")).alias("cwd"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("hook_event_name"),
        F.lit("m1").alias("model"),
        F.col("user_id").cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("transcript_path"),
        F.col("event_id").cast("string").alias("turn_id"),
    )
    rows = ledger.envelope(views.table(spark, sf, "events").select("event_id", hook.alias("hook")), "codex", ["cwd", "hook_event_name", "model", "session_id", "transcript_path", "turn_id"])
    return rows.select("event_id", "event_type", "source_id", "trust_level", "external_event_id")


def occurrence_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a prompt: how often the session's user lines say the same."""
    turns = views.turns(views.table(spark, sf, "conversations"))
    prompts = turns.select("session_id", "ordinal", F.col("text").alias("prompt"))
    return ledger.occurrence_keys(prompts, turns.select("session_id", "role", "text")).select("session_id", "ordinal", "occurrence_key")


def pending_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    return ledger.settlement_queue(events, events.where("raw_event_id % 3 = 0").select("raw_event_id"))


def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """The next batch of a hundred: a top-k report by contract."""
    return ledger.fifo(pending_boundaries(spark, sf), ["occurred_at", "raw_event_id"]).select("raw_event_id", F.col("place").cast("long").alias("place"))


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as failed attempts on their user's queue entry."""
    errors = views.table(spark, sf, "events").where("event_type = 'error'")
    return ledger.dead_letters(errors.select(F.col("user_id").alias("raw_event_id"), F.col("props").alias("error"), F.struct("ts", "event_id").alias("at")))


def recent_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger.recent(_events(spark, sf), "workspace_id", [F.col("occurred_at").desc(), F.col("raw_event_id").desc()], 10)
    return rows.select("workspace_id", F.col("rank").cast("long").alias("rank"), "raw_event_id", "event_type", "occurred_at")


def activation_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.activation(_events(spark, sf), AS_OF)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), F.when(F.col("value") > 100, "failed").otherwise("ok").alias("status"))


def job_retention(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.keep_newest(_runs(spark, sf)).select("job", "run_id", F.col("rank").cast("long").alias("rank"))


def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest(_runs(spark, sf))


def backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Two queues in one pass each: settlement of boundary events and derivation of documents."""
    events = _events(spark, sf).where(F.col("hook").isin(*ledger.BOUNDARY))
    one = events.agg(F.count_if(F.col("raw_event_id") % 3 != 0).alias("settlement_pending"), F.count_if(F.col("value") > 400).alias("settlement_failed"))
    two = views.table(spark, sf, "documents").agg(F.count_if(F.col("doc_id") % 2 == 1).alias("derivation_pending"), F.count_if(F.col("text").isNull() | (F.length("text") == 0)).alias("derivation_failed"))
    return one.crossJoin(two)


def unsettled_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary events that neither opened nor settled an interval: an anti-join on the two trigger ids as one key."""
    events = _events(spark, sf)
    rows = intervals.labelled(events, ["occurred_at", "raw_event_id"])
    ends = F.col("stops") & (F.col("hook") == "Stop")
    used = rows.select(F.explode(F.array(F.when(F.col("opens"), F.col("raw_event_id")), F.when(ends, F.col("raw_event_id")))).alias("raw_event_id")).where("raw_event_id IS NOT NULL").distinct()
    return events.where(F.col("hook").isin(*ledger.BOUNDARY)).join(used, "raw_event_id", "left_anti").select("raw_event_id", "session_id", "hook")


def activity_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.intervals(_events(spark, sf), ["occurred_at", "raw_event_id"])


def active_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.active(activity_intervals(spark, sf))


def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.idle_sessions(_events(spark, sf))


def score(rows: DataFrame) -> Column:
    """The confidence of scored events: rows with event_type, base, occurred_at and the counts before."""
    age = F.timestamp_diff("DAY", F.col("occurred_at").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    return claims.confidence(base=F.col("base"), event_type=F.col("event_type"), kind=F.lit("decision"), actor=F.lit("human"), source=F.lit("git"), trusted=F.lit(True), own_source=F.lit("own"), age_days=age, prior_events=F.col("prior_events"), prior_against=F.col("prior_against"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = claims.prior_counts(views.claim_events(views.table(spark, sf, "events")))
    return rows.withColumn("confidence", score(rows))


def claim_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("claim_key", "seq", "prior_events", "prior_against", "confidence")


def claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered and filtered distinct counts per claim."""
    rows = views.claim_events(views.table(spark, sf, "events"))
    return rows.groupBy("claim_key").agg(F.count_if(F.col("event_type") == "contradicted").alias("n_against"), F.count_distinct(F.when(F.col("event_type").isin(*claims.RECURRING), F.to_date("occurred_at"))).alias("n_days"))


def current_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims.project(_scored(spark, sf).withColumn("governed", claims.governed(F.col("event_type"), F.col("evidence_type"))))


def live_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims.live(current_claims(spark, sf)).select("workspace_id", F.col("rank").cast("long").alias("rank"), "claim_key", "state", "confidence")


def claim_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a review action on its user's claim (keys moved by three meet unknown claims)."""
    names = F.array(*[F.lit(x) for x in ("accept", "reject", "pin", "promote", "merge", "noop")])
    events = views.table(spark, sf, "events")
    actions = events.select(F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"), (F.col("user_id") + 3 * (F.col("event_id") % 20 / 10).cast("int")).alias("claim_key"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("action"), F.col("event_id").alias("action_id"))
    out = claims.review(actions, current_claims(spark, sf))
    return out.groupBy("action", "event_type", "refused").agg(F.count("*").alias("n"))


def canonical_users(spark: SparkSession, sf: str) -> DataFrame:
    customers = views.table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    return ledger.canonical_users(customers, ["c_nationkey", "c_mktsegment"], ["c_custkey"]).select("c_custkey", "canonical_id", "is_canonical")


def dimension_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers upserted by customers of the same number, where they have a positive balance."""
    old = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = views.table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("balance"))
    return ledger.merge_dimension(old, new, "id", ["name", "balance"])


_RAW = """raw AS (SELECT 'w' || (user_id % 4) AS workspace_id, 'codex:local' AS source_id, event_id::VARCHAR AS external_event_id, event_id AS raw_event_id,
  user_id::VARCHAR AS session_id, CASE event_type WHEN 'purchase' THEN 'Stop' WHEN 'signup' THEN 'SessionStart' ELSE 'UserPromptSubmit' END AS hook,
  CASE WHEN event_type = 'signup' THEN 'clear' END AS start_source, ts AS occurred_at, value, props AS payload FROM events)"""
_LABELLED = (
    _RAW
    + """,
l0 AS (SELECT *, lag(occurred_at) OVER w AS before, coalesce(occurred_at > lag(occurred_at) OVER w + INTERVAL 30 MINUTE, false) AS idle FROM raw WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, raw_event_id)),
l1 AS (SELECT *, coalesce(last_value(CASE WHEN NOT (hook = 'Stop' AND idle) THEN hook = 'Stop' END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY occurred_at, raw_event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS stops,
  hook = 'SessionStart' AND coalesce(start_source IN ('clear', 'compact'), false) AS clears FROM l0),
l2 AS (SELECT *, before IS NULL OR coalesce(lag(stops) OVER w, false) OR clears OR idle AS opens FROM l1 WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, raw_event_id)),
l3 AS (SELECT *, (sum(opens::INT) OVER (PARTITION BY session_id ORDER BY occurred_at, raw_event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::BIGINT AS interval_ordinal FROM l2),
l4 AS (SELECT *, lead(occurred_at) OVER w AS next_at, lead(clears) OVER w AS next_clears, coalesce(lead(opens) OVER w, true) AS is_last FROM l3 WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, raw_event_id)),
ivals AS (SELECT session_id, interval_ordinal, min(occurred_at) AS started_at, count(*) AS n_events,
  max(CASE WHEN is_last THEN CASE WHEN stops THEN 'stop_event' WHEN next_at IS NULL THEN NULL WHEN next_clears THEN 'clear_context' ELSE 'idle_timeout' END END) AS reason,
  max(CASE WHEN is_last THEN CASE WHEN stops THEN occurred_at WHEN next_at IS NULL THEN NULL WHEN next_clears THEN next_at ELSE occurred_at + INTERVAL 30 MINUTE END END) AS ended_at
  FROM l4 GROUP BY 1, 2)"""
)
_CLAIMS = """ce AS (SELECT 'w' || (user_id % 4) AS workspace_id, user_id AS claim_key, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'extracted' WHEN 'view' THEN 'supported' WHEN 'click' THEN ['pinned', 'watched', 'unpinned', 'unwatched'][event_id % 4 + 1] WHEN 'purchase' THEN 'promoted' ELSE 'contradicted' END AS event_type,
  event_type = 'purchase' AND event_id % 2 = 0 AS governed, ts AS occurred_at, least(1.0::DOUBLE, value / 500) AS base FROM events),
cp AS (SELECT *, coalesce(sum((event_type IN ('extracted', 'supported'))::INT) OVER w, 0)::BIGINT AS prior_events, coalesce(sum((event_type = 'contradicted')::INT) OVER w, 0)::BIGINT AS prior_against
  FROM ce WINDOW w AS (PARTITION BY workspace_id, claim_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cs AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(base + 0.08::DOUBLE
  + (-least(0.16::DOUBLE, 0.08::DOUBLE * prior_against) - CASE event_type WHEN 'contradicted' THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END)
  + CASE event_type WHEN 'promoted' THEN 0.12::DOUBLE WHEN 'extracted' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END + 0.0::DOUBLE
  + least(0.12::DOUBLE, 0.04::DOUBLE * prior_events)
  + CASE WHEN age <= 7 THEN 0.03::DOUBLE WHEN age <= 30 THEN 0.01::DOUBLE WHEN age <= 90 THEN 0.0::DOUBLE ELSE -0.08::DOUBLE END
  + (0.08::DOUBLE + 0.03::DOUBLE), 4))) AS confidence
  FROM (SELECT *, datesub('day', occurred_at, TIMESTAMP '2024-02-01 00:00:00') AS age FROM cp)),
coded AS (SELECT *, CASE event_type WHEN 'extracted' THEN 'candidate' WHEN 'promoted' THEN 'supported' WHEN 'pinned' THEN NULL WHEN 'unpinned' THEN NULL WHEN 'watched' THEN NULL WHEN 'unwatched' THEN NULL ELSE event_type END AS state,
  CASE event_type WHEN 'contradicted' THEN 2 WHEN 'supported' THEN 1 WHEN 'promoted' THEN 1 ELSE 0 END AS rank FROM cs),
nums AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, claim_key ORDER BY seq) AS i FROM coded),
fold AS (SELECT workspace_id, claim_key, i, state, rank, occurred_at AS observed_at, confidence, seq AS latest_seq, false AS pinned, false AS watched, NULL::VARCHAR AS last_review, CASE WHEN state IS NULL THEN 0 ELSE 1 END AS n FROM nums WHERE i = 1
  UNION ALL
  SELECT f.workspace_id, f.claim_key, e.i,
    CASE WHEN go THEN e.state ELSE f.state END, CASE WHEN go THEN e.rank ELSE f.rank END, CASE WHEN go THEN e.occurred_at ELSE f.observed_at END,
    CASE WHEN go THEN e.confidence ELSE f.confidence END, CASE WHEN go THEN e.seq ELSE f.latest_seq END,
    CASE WHEN f.n > 0 AND e.event_type IN ('pinned', 'unpinned') THEN e.event_type = 'pinned' ELSE f.pinned END,
    CASE WHEN f.n > 0 AND e.event_type IN ('watched', 'unwatched') THEN e.event_type = 'watched' ELSE f.watched END,
    CASE WHEN f.n > 0 AND e.state IS NULL THEN e.event_type ELSE f.last_review END, f.n + go::INT
  FROM fold f JOIN nums e ON e.workspace_id = f.workspace_id AND e.claim_key = f.claim_key AND e.i = f.i + 1,
    LATERAL (SELECT e.state IS NOT NULL AND (f.n = 0 OR (e.governed AND f.observed_at <= e.occurred_at) OR (f.observed_at < e.occurred_at AND (f.state = 'candidate' OR e.rank >= f.rank)) OR (f.observed_at = e.occurred_at AND e.rank >= f.rank)) AS go) g),
cc AS (SELECT workspace_id, claim_key, state, observed_at, confidence, latest_seq, pinned, watched, last_review, n::BIGINT AS n_advances FROM fold
  WHERE n > 0 AND (workspace_id, claim_key, i) IN (SELECT (workspace_id, claim_key, max(i)) FROM nums GROUP BY workspace_id, claim_key))"""

ORACLES = {
    "ledger_dedupe": f"""WITH {_RAW}, inc AS (SELECT *, raw_event_id * 2 AS arrival FROM raw UNION ALL SELECT *, raw_event_id * 2 + 1 FROM raw WHERE raw_event_id % 7 = 0)
      SELECT workspace_id, source_id, external_event_id, any_value(session_id) AS session_id, any_value('codex.' || hook) AS event_type, min(arrival) AS arrival FROM inc WHERE raw_event_id % 11 <> 0 GROUP BY 1, 2, 3""",
    "ingest_acks": f"""WITH {_RAW}, items AS (SELECT raw_event_id * 2 AS item, CASE WHEN raw_event_id % 13 <> 0 THEN external_event_id END AS ext, * FROM raw UNION ALL SELECT raw_event_id * 2 + 1, external_event_id, * FROM raw WHERE raw_event_id % 5 = 0),
      coded AS (SELECT *, CASE WHEN ext IS NULL THEN 'missing_id' WHEN payload IS NULL OR NOT json_valid(payload) THEN 'bad_payload' WHEN (CASE WHEN raw_event_id % 17 = 0 THEN -value ELSE value END) < 0 THEN 'bad_value' END AS code FROM items),
      firsts AS (SELECT workspace_id, ext, min(item) AS first_item FROM coded WHERE code IS NULL GROUP BY 1, 2)
      SELECT c.item, c.ext AS external_event_id, CASE WHEN code IS NOT NULL THEN 'error' WHEN raw_event_id % 11 = 0 OR item <> first_item THEN 'duplicate' ELSE 'stored' END AS status, code FROM coded c LEFT JOIN firsts f ON f.workspace_id = c.workspace_id AND f.ext = c.ext""",
    "external_event_ids": """SELECT event_id, 'codex.' || name AS event_type, 'codex:local' AS source_id, 'raw' AS trust_level,
      'codex:' || name || ':' || user_id || ':' || event_id || '::' || sha256('{"cwd":"/w/' || (user_id % 4) || '","hook_event_name":"' || raw_name || '","model":"m1","session_id":"' || user_id || '","turn_id":"' || event_id || '"}') AS external_event_id
      FROM (SELECT *, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS raw_name, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS name FROM events)""",
    "occurrence_keys": """SELECT c.conv_id AS session_id, c.turn AS ordinal, CASE WHEN n > 0 THEN 'transcript-' || n ELSE '' END AS occurrence_key FROM conversations c
      LEFT JOIN (SELECT conv_id, text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1, 2) u ON u.conv_id = c.conv_id AND u.text = c.text""",
    "pending_boundaries": f"WITH {_RAW} SELECT workspace_id, raw_event_id, session_id, occurred_at FROM raw WHERE hook IN ('Stop', 'SessionStart') AND raw_event_id % 3 <> 0",
    "pending_work": f"WITH {_RAW} SELECT raw_event_id, row_number() OVER (ORDER BY occurred_at, raw_event_id) AS place FROM raw WHERE hook IN ('Stop', 'SessionStart') AND raw_event_id % 3 <> 0 ORDER BY place LIMIT 100",
    "dead_letters": "SELECT user_id AS raw_event_id, count(*) AS attempts, arg_max(substr(props, 1, 2000), (ts, event_id)) AS last_error, CASE WHEN count(*) >= 5 THEN 'failed' ELSE 'pending' END AS status FROM events WHERE event_type = 'error' GROUP BY 1",
    "recent_events": f"WITH {_RAW} SELECT workspace_id, row_number() OVER w AS rank, raw_event_id, 'codex.' || hook AS event_type, occurred_at FROM raw WINDOW w AS (PARTITION BY workspace_id ORDER BY occurred_at DESC, raw_event_id DESC) QUALIFY rank <= 10",
    "activation_evidence": f"""WITH {_RAW}, s AS (SELECT workspace_id, max(occurred_at) FILTER (hook <> 'Stop') AS last_seen, count(*) FILTER (hook <> 'Stop') AS n_real, bool_or(coalesce(start_source = 'clear', false)) AS c FROM raw GROUP BY 1)
      SELECT workspace_id, CASE WHEN last_seen IS NULL THEN 'no_evidence' WHEN last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 'active' ELSE 'stale' END AS state, n_real, CASE WHEN c THEN 'clear' ELSE '' END AS observed, CASE WHEN c THEN 'compact,resume,startup' ELSE 'clear,compact,resume,startup' END AS unproven FROM s""",
    "job_retention": "SELECT event_type AS job, event_id AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 50",
    "latest_runs": "SELECT DISTINCT ON (event_type) event_type AS job, event_id AS run_id, CASE WHEN value > 100 THEN 'failed' ELSE 'ok' END AS status, ts AS finished_at FROM events ORDER BY event_type, ts DESC, event_id DESC",
    "backlog": f"WITH {_RAW} SELECT * FROM (SELECT count(*) FILTER (raw_event_id % 3 <> 0) AS settlement_pending, count(*) FILTER (value > 400) AS settlement_failed FROM raw WHERE hook <> 'UserPromptSubmit'), (SELECT count(*) FILTER (doc_id % 2 = 1) AS derivation_pending, count(*) FILTER (text IS NULL OR length(text) = 0) AS derivation_failed FROM documents)",
    "unsettled_boundaries": f"WITH {_LABELLED} SELECT raw_event_id, session_id, hook FROM l3 WHERE hook <> 'UserPromptSubmit' AND NOT opens AND NOT (stops AND hook = 'Stop')",
    "activity_intervals": f"WITH {_LABELLED} SELECT *, CASE WHEN reason IS NULL THEN 'active' ELSE 'settled' END AS status FROM ivals",
    "active_intervals": f"WITH {_LABELLED} SELECT session_id, max(interval_ordinal) AS interval_ordinal FROM ivals WHERE reason IS NULL GROUP BY 1",
    "idle_sessions": f"""WITH {_RAW}, g AS (SELECT *, sum((before IS NULL OR occurred_at > before + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY session_id ORDER BY occurred_at, raw_event_id) AS k FROM (SELECT *, lag(occurred_at) OVER (PARTITION BY session_id ORDER BY occurred_at, raw_event_id) AS before FROM raw))
      SELECT session_id, min(occurred_at) AS started_at, max(occurred_at) + INTERVAL 30 MINUTE AS ended_at, count(*) AS n_events FROM g GROUP BY session_id, k""",
    "claim_scores": f"WITH RECURSIVE {_CLAIMS} SELECT claim_key, seq, prior_events, prior_against, confidence FROM cs",
    "claim_evidence": f"WITH RECURSIVE {_CLAIMS} SELECT claim_key, count(*) FILTER (event_type = 'contradicted') AS n_against, count(DISTINCT occurred_at::DATE) FILTER (event_type IN ('extracted', 'supported')) AS n_days FROM ce GROUP BY 1",
    "current_claims": f"WITH RECURSIVE {_CLAIMS} SELECT * FROM cc",
    "live_claims": f"WITH RECURSIVE {_CLAIMS} SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY confidence DESC, observed_at DESC, claim_key) AS rank, claim_key, state, confidence FROM cc WHERE state NOT IN ('rejected', 'superseded') QUALIFY rank <= 8",
    "claim_reviews": f"""WITH RECURSIVE {_CLAIMS}, a AS (SELECT 'w' || (user_id % 4) AS workspace_id, user_id + 3 * (event_id % 20 // 10) AS claim_key, ['accept', 'reject', 'pin', 'promote', 'merge', 'noop'][event_id % 6 + 1] AS action FROM events),
      b AS (SELECT a.action, MAP {{'accept': 'supported', 'reject': 'rejected', 'pin': 'pinned', 'promote': 'promoted', 'merge': 'merged'}}[a.action] AS event_type, cc.state FROM a LEFT JOIN cc USING (workspace_id, claim_key))
      SELECT action, event_type, CASE WHEN state IS NULL THEN 'unknown_claim' WHEN action = 'promote' AND state IN ('rejected', 'superseded') THEN 'terminal_claim' WHEN event_type IS NULL THEN 'unknown_action' END AS refused, count(*) AS n FROM b GROUP BY ALL""",
    "canonical_users": "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical_id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) = c_custkey AS is_canonical FROM customer",
    "dimension_merge": "SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, s_name) AS name, coalesce(c_acctbal, s_acctbal) AS balance FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = s_suppkey",
}

QUERIES = {name: globals()[name] for name in ORACLES}
