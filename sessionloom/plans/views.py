"""Further queries: nested values, scopes, views of claims, lineage deletion, refreshes and upserts. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, graph, intervals, ledger, recall, sessions
from ..sources import views
from . import events, sessions as session_plans


def json_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties with a path beside and under them: values are redacted, keys are not."""
    extra = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "/home/a/k": "/home/user/'), F.col("event_type"), F.lit('.txt", "in": {"x": ["/srv/b/c", "https://e.org/a/b"]}}'))
    return views.table(spark, sf, "events").select("event_id", T.redact_json(extra).alias("redacted"))


def scoped_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = views.turns(views.table(spark, sf, "conversations"))
    return sessions.scoped(turns, role="user", session_id=None).groupBy("session_id").agg(F.count("*").alias("n"))


def claim_views(spark: SparkSession, sf: str) -> DataFrame:
    """Flags and titles of the current claims."""
    rows = events.current_claims(spark, sf)
    title = F.concat(F.lit("a claim with a rather long text that has to be cut for its title, number "), F.col("claim_key").cast("string"))
    return rows.select("claim_key", "pinned", (F.col("state") == "supported").alias("promotable"), claims.default_title(title).alias("title"))


def review_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of each user's first and last event: new ones win, review and decision ones of the old survive."""
    rows = views.table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("a"), F.max_by("event_type", "event_id").alias("b"))
    old = F.create_map(F.lit("reviewNote"), F.col("a"), F.lit("color"), F.col("a"))
    new = F.create_map(F.lit("shape"), F.col("b"))
    merged = rows.select("user_id", claims.keep_review_attributes(old, new).alias("m"))
    return merged.select("user_id", F.col("m")["reviewNote"].alias("note"), F.col("m")["shape"].alias("shape"), F.size("m").alias("n"))


def claim_invalidation(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that lose their evidence when every five-hundredth event is redacted."""
    log = views.claim_events(views.table(spark, sf, "events")).withColumn("raw_event_id", F.col("seq"))
    kept, marked = claims.invalidate(events.current_claims(spark, sf), log, log.where("seq % 500 = 0"))
    tombs = marked.groupBy("claim_key").agg(F.count_if("redacted").alias("n_redacted"))
    return kept.select("claim_key", "state").join(tombs, "claim_key")


def claim_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Claim events delivered twice count once: the first arrival."""
    log = views.claim_events(views.table(spark, sf, "events")).withColumn("raw_event_id", F.col("seq"))
    again = log.withColumn("seq", F.col("seq") + 1_000_000)
    return claims.first_per_key(log.unionByName(again)).groupBy("claim_key").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def lineage_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the lineages that hold a session divisible by 25 are deleted from findings and evidence."""
    loaded = sessions.load_findings(session_plans._outputs(spark, sf))
    lines = graph.lineage(views.continuation_edges(views.table(spark, sf, "conversations")))
    hit = lines.where("node % 25 = 0").select("lineage").distinct()
    records = lines.join(hit, "lineage", "left_semi").select(F.col("node").cast("string").alias("record_id"))
    kept = sessions.delete_records({k: loaded[k] for k in ("findings", "evidence")}, records)
    one = kept["findings"].groupBy("record_id").agg(F.count("*").alias("n_findings"))
    two = kept["evidence"].groupBy("record_id").agg(F.count("*").alias("n_evidence"))
    return one.join(two, "record_id", "left")


def workspace_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Per workspace: live claims, sessions, last event; each is aggregated before the join."""
    raw = views.raw_events(views.table(spark, sf, "events"))
    seen = raw.groupBy("workspace_id").agg(F.count_distinct("session_id").alias("n_sessions"), F.max("occurred_at").alias("last_event"))
    held = events.current_claims(spark, sf).groupBy("workspace_id").agg(F.count_if(~F.col("state").isin("rejected", "superseded")).alias("n_live"), F.count_if("pinned").alias("n_pinned"))
    return seen.join(held, "workspace_id", "left")


def nested_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's intervals with the kinds of their events."""
    rows = intervals.labelled(views.raw_events(views.table(spark, sf, "events")), ["occurred_at", "raw_event_id"])
    turns = rows.select("session_id", "interval_ordinal", F.col("raw_event_id").alias("ordinal"), F.col("hook").alias("label"))
    return sessions.nested_detail(rows.select("session_id", "interval_ordinal").distinct(), turns)


def source_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Continuation edges with a call id, a parent turn id or neither."""
    table = views.table(spark, sf, "conversations")
    turns = views.tool_turns(table).withColumn("turn_id", F.concat_ws("/", F.col("session_id").cast("string"), F.col("ordinal").cast("string")))
    edges = views.continuation_edges(table)
    edges = edges.select("source", "target", F.when(F.col("source") % 3 == 0, F.concat(F.col("source").cast("string"), F.lit("-1"))).alias("call_id"), F.when(F.col("source") % 3 == 1, F.concat(F.col("source").cast("string"), F.lit("/1"))).alias("parent_turn_id"))
    return sessions.source_turns(edges, turns).select("source", "target", "source_turn")


def refresh_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of even number are normalised again, without a title for those divisible by four."""
    stored = views.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.lit("old").alias("title"), F.min("turn").alias("n"))
    fresh = views.table(spark, sf, "conversations").where("conv_id % 2 = 0").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n")).withColumn("title", F.when(F.col("session_id") % 4 != 0, "new"))
    return sessions.refresh_sessions(stored, fresh, ["title", "n"])


def embedding_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors with fresh ones in place of every third."""
    stored = views.table(spark, sf, "embeddings").select("vec_id", F.lit("v1").alias("version"))
    fresh = stored.where("vec_id % 3 = 0").withColumn("version", F.lit("v2")).unionByName(stored.where("vec_id % 3 = 1").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.lit("v2").alias("version")))
    return sessions.upsert(stored, fresh, ["vec_id"])


def vector_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Query vectors: some cut short, some with a part that is not a number."""
    rows = views.table(spark, sf, "embeddings")
    broken = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 5 == 1, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(F.col("embedding"))
    return rows.select("vec_id", recall.valid_vector(broken, 64).alias("valid"))


def context_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The most important entries of each workspace."""
    rows = views.table(spark, sf, "part").select(F.concat(F.lit("w"), (F.col("p_partkey") % 4).cast("string")).alias("workspace_id"), F.col("p_partkey").alias("entry"), F.col("p_retailprice").alias("importance"))
    out = ledger.recent(rows, "workspace_id", [F.col("importance").desc(), F.col("entry")], 50)
    return out.select("workspace_id", "entry", F.col("rank").cast("long").alias("rank"))


_LIN = "le AS (SELECT DISTINCT a.conv_id AS source FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 5 <> 4), ln AS (SELECT source AS node FROM le UNION SELECT source + 1 FROM le), lt AS (SELECT node, (node // 5) * 5 + coalesce((SELECT max(k) FROM range(1, 5) t(k) WHERE k <= node % 5 AND (node // 5) * 5 + k - 1 NOT IN (SELECT source FROM le)), 0) AS lineage FROM ln)"

ORACLES = {
    "json_redaction": """SELECT event_id, substr(props, 1, length(props) - 1) || ', "/home/a/k": "[local-path-redacted]", "in": {"x": ["[local-path-redacted]", "https://e.org/a/b"]}}' AS redacted FROM events""",
    "scoped_turns": "SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "claim_views": f"WITH RECURSIVE {events._CLAIMS} SELECT claim_key, pinned, state = 'supported' AS promotable, substr('a claim with a rather long text that has to be cut for its title, number ' || claim_key, 1, 69) || '...' AS title FROM cc",
    "review_attributes": "SELECT user_id, arg_min(event_type, event_id) AS note, arg_max(event_type, event_id) AS shape, 2::INT AS n FROM events GROUP BY 1",
    "claim_invalidation": f"WITH RECURSIVE {events._CLAIMS} SELECT claim_key, state, 0::BIGINT AS n_redacted FROM cc WHERE claim_key NOT IN (SELECT user_id FROM events WHERE event_id % 500 = 0)",
    "claim_dedupe": "SELECT user_id AS claim_key, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1",
    "lineage_delete": f"WITH {session_plans._FIND}, {_LIN} SELECT conv_id::VARCHAR AS record_id, count(*) AS n_findings, count(*) AS n_evidence FROM fi WHERE conv_id NOT IN (SELECT conv_id FROM vio) AND conv_id NOT IN (SELECT node FROM lt WHERE lineage IN (SELECT lineage FROM lt WHERE node % 25 = 0)) GROUP BY 1",
    "workspace_snapshot": f"WITH RECURSIVE {events._CLAIMS}, s AS (SELECT 'w' || (user_id % 4) AS workspace_id, count(DISTINCT user_id) AS n_sessions, max(ts) AS last_event FROM events GROUP BY 1) SELECT s.*, n_live, n_pinned FROM s LEFT JOIN (SELECT workspace_id, count(*) FILTER (state NOT IN ('rejected', 'superseded')) AS n_live, count(*) FILTER (pinned) AS n_pinned FROM cc GROUP BY 1) USING (workspace_id)",
    "nested_detail": f"WITH {events._LABELLED}, d AS (SELECT session_id, interval_ordinal, string_agg(hook, '+' ORDER BY raw_event_id) AS t FROM l3 GROUP BY 1, 2) SELECT session_id, count(*) AS n_intervals, string_agg(interval_ordinal || '=' || t, ';' ORDER BY interval_ordinal) AS detail FROM d GROUP BY 1",
    "source_turns": f"WITH {session_plans._PART}, e AS (SELECT DISTINCT a.conv_id AS source, a.conv_id + 1 AS target FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 5 <> 4) SELECT source, target, coalesce((SELECT min(turn) FROM tp WHERE conv_id = source AND part_type <> 'text' AND source % 3 = 0 AND call_id = source || '-1'), (SELECT min(turn) FROM tp WHERE conv_id = source AND source % 3 = 1 AND turn = 1), (SELECT min(turn) FROM tp WHERE conv_id = source)) AS source_turn FROM e",
    "refresh_sessions": "SELECT conv_id AS session_id, CASE WHEN conv_id % 4 = 2 THEN 'new' ELSE 'old' END AS title, CASE WHEN conv_id % 2 = 0 THEN count(*) ELSE min(turn) END AS n FROM conversations GROUP BY conv_id",
    "embedding_upsert": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS version FROM embeddings UNION ALL SELECT vec_id + 1000000, 'v2' FROM embeddings WHERE vec_id % 3 = 1",
    "vector_validation": "SELECT vec_id, vec_id % 5 > 1 AS valid FROM embeddings",
    "context_entries": "SELECT 'w' || (p_partkey % 4) AS workspace_id, p_partkey AS entry, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 50",
}

QUERIES = {name: globals()[name] for name in ORACLES}
