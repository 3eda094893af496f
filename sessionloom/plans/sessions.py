"""Queries over sessions: tools, details, lineage, findings, context documents, safety, embeddings and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, intervals, segments, sessions
from ..sources import views
from . import documents, events


def _tools(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.tool_runs(views.tool_turns(views.table(spark, sf, "conversations")))


def tool_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _tools(spark, sf).select("session_id", "ordinal", "part_type", "run")


def turn_segments(spark: SparkSession, sf: str) -> DataFrame:
    """All turns to segments, tool calls and answers as groups."""
    out = segments.derive(views.part_turns(views.table(spark, sf, "conversations")))
    return out.select(
        "session_id", F.col("segment").cast("long").alias("segment"), "ordinal", "segment_kind", F.col("chunk_count").cast("long").alias("chunk_count"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"),
        F.md5("search_text").alias("digest"), F.array_join("part_types", ",").alias("part_types"), F.array_join("filter_reasons", ",").alias("reasons"), "group_call", F.col("member_index").cast("long").alias("member_index"), F.array_join(F.transform("group_ordinals", lambda o: o.cast("string")), ",").alias("group_ordinals"), F.col("segment_raw_span.char_end").cast("long").alias("raw_end"),
    )


def tool_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.tool_pairs(_tools(spark, sf))


def skipped_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Turns by length stand for filter reasons: very short and very long ones are skipped."""
    rows = views.turns(views.table(spark, sf, "conversations")).withColumn("n_chars", F.length("text"))
    reason = F.when(F.col("n_chars") > 400, "huge_raw_log").when(F.col("n_chars") < 100, "secret")
    return sessions.skipped_summary(rows.select("session_id", "ordinal", "n_chars", reason.alias("reason"), F.when(F.col("role") == "user", "turn_skipped").otherwise("tool_group_skipped").alias("segment_kind")))


def session_detail(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_detail(views.turns(views.table(spark, sf, "conversations")))


def session_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_bounds(views.turns(views.table(spark, sf, "conversations")))


def capped_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of documents as segments of a turn, the first two of each."""
    docs = views.table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("turn_id"), F.posexplode(T.chunk_bounds(F.size(T.tokens(F.col("text"))))).alias("ordinal", "b"))
    return sessions.capped(rows, 2).select("turn_id", "ordinal", "truncated")


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    return graph.lineage(views.continuation_edges(views.table(spark, sf, "conversations")))


def continuations(spark: SparkSession, sf: str) -> DataFrame:
    """The anchor of a turn is the session before its own; every seventh session names a second one."""
    turns = views.turns(views.table(spark, sf, "conversations"))
    anchor = F.when((F.col("session_id") % 7 == 0) & (F.col("ordinal") % 2 == 1), F.col("session_id") - 2).otherwise(F.col("session_id") - 1)
    return graph.continuations(turns.withColumn("anchor", anchor), turns)


def _children(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose parent is the session of a third of their number, in the same workspace."""
    rows = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    rows = rows.select("session_id", (F.col("session_id") % 2).alias("workspace_id"), F.concat(F.lit("h"), F.col("session_id").cast("string")).alias("harness_id"), F.concat(F.lit("h"), F.floor(F.col("session_id") / 3).cast("string")).alias("parent_id"))
    return graph.children(rows)


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    return _children(spark, sf)


def edge_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Derived child edges against stored ones: even targets are stored, every tenth by hand, plus stale ones."""
    wanted = _children(spark, sf)
    stored = wanted.where("target % 2 = 0").select("source", "target", (F.col("target") % 10 != 0).alias("derived"))
    stale = wanted.where("target % 4 = 1").select("source", (F.col("target") + 1000000).alias("target"), F.lit(True).alias("derived"))
    return graph.reconcile(stored.unionByName(stale), wanted)


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Extractor outputs made of conversations: a finding per turn, each building on the one before."""
    turns = views.table(spark, sf, "conversations")
    key = F.concat(F.lit("k"), F.when((F.col("conv_id") % 9 == 4), F.floor(F.col("turn") / 2)).otherwise(F.col("turn")).cast("string"))
    kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "decision").otherwise("learning")
    finding = F.struct("turn", F.struct(key.alias("key"), kind.alias("type"), "text", F.array(F.struct(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("turn"))).alias("evidence")).alias("f"))
    edge = F.when(F.col("turn") > 0, F.struct(F.lit("builds_on").alias("kind"), key.alias("fromKey"), F.concat(F.lit("k"), (F.col("turn") - 1).cast("string")).alias("toKey")))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(finding)).alias("fs"), F.collect_list(edge).alias("ds"))
    body = F.to_json(F.struct(F.lit("n").alias("narrative"), F.transform("fs", lambda x: x["f"]).alias("findings"), F.col("ds").alias("dispositions")))
    return rows.select(F.col("conv_id").cast("string").alias("record_id"), body.alias("body"))


def consolidation_violations(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.load_findings(_outputs(spark, sf))["violations"].groupBy("record_id", "code").agg(F.count("*").alias("n"))


def consolidation_load(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.load_findings(_outputs(spark, sf))["findings"].select("record_id", "ordinal", "key", "type")


def record_details(spark: SparkSession, sf: str) -> DataFrame:
    loaded = sessions.load_findings(_outputs(spark, sf))
    return sessions.record_details(loaded["findings"], loaded["evidence"])


def _context(spark: SparkSession, sf: str) -> DataFrame:
    claims = events.current_claims(spark, sf).withColumn("claim_text", F.concat(F.lit("claim "), F.col("claim_key").cast("string")))
    entries = views.table(spark, sf, "supplier").select(
        F.concat(F.lit("w"), (F.col("s_suppkey") % 4).cast("string")).alias("workspace_id"),
        F.col("s_name").alias("title"),
        F.concat(F.lit("context://"), F.col("s_suppkey").cast("string")).alias("link"),
        F.col("s_acctbal").alias("importance"),
        F.when(F.col("s_suppkey") % 3 == 0, "always").otherwise("manual").alias("include_policy"),
    )
    raw = views.raw_events(views.table(spark, sf, "events"))
    workspaces = raw.select("workspace_id").distinct().withColumn("summary", F.when(F.col("workspace_id") == "w1", F.lit("the first")))
    return sessions.context_documents(claims, entries, raw, workspaces)


def context_document(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf).select("workspace_id", *[F.array_join(c, "\n").alias(c) for c in ("profile", "claims", "entries", "events")])


def context_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.markdown(_context(spark, sf), events.AS_OF)


def context_links(spark: SparkSession, sf: str) -> DataFrame:
    parts = views.table(spark, sf, "part")
    entries = parts.select(F.concat(F.lit("w"), (F.col("p_partkey") % 4).cast("string")).alias("workspace_id"), F.col("p_brand").alias("source_type"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("key"))
    bindings = parts.select(F.concat(F.lit("w"), (F.col("p_partkey") % 4).cast("string")).alias("workspace_id"), F.col("p_brand").alias("source_type")).distinct().withColumn("enabled", F.col("workspace_id") != "w3")
    return sessions.context_links(entries, bindings).select("workspace_id", "key", "link", "resolved_key")


def session_erasure(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every tenth user go from events and intervals; the counts of what goes, by table."""
    raw = views.raw_events(views.table(spark, sf, "events"))
    tables = {"raw_events": raw, "activity_intervals": intervals.intervals(raw, ["occurred_at", "raw_event_id"])}
    gone = raw.where(F.col("session_id").cast("long") % 10 == 0)
    return sessions.erase(tables, gone)[1]


def event_association(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_events(views.table(spark, sf, "events"))
    chosen = raw.where(F.col("session_id").cast("long") % 10 == 0).select("session_id").distinct()
    listed = raw.where("raw_event_id % 100 = 0").select("session_id", F.array(F.col("raw_event_id") + 1, F.col("raw_event_id") + 2).alias("raw_event_ids"))
    return sessions.associated_events(raw, chosen, listed)


def hard_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of the sources: a secret word in any of them empties the source's bodies and adds a redacted one."""
    shots = views.snapshots(views.table(spark, sf, "documents")).withColumn("session_id", F.concat_ws("/", "session_id", (F.col("captured") % 37).cast("string")))
    out = sessions.hard_redaction(shots, (("token", "[key]", True),))
    return out.select("session_id", "captured", "status", "is_active", F.md5("content").alias("digest"))


def embedding_absence(spark: SparkSession, sf: str) -> DataFrame:
    return _missing(spark, sf).select("segment_id")


def _missing(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as segments; those whose number is that of a vector have an embedding already."""
    rows = views.table(spark, sf, "conversations")
    key = {"provider": F.lit("local"), "model": F.lit("hash"), "dimensions": F.lit(64)}
    segments = rows.select((F.col("conv_id") * 8 + F.col("turn")).alias("segment_id"), "text").withColumns(key)
    stored = views.table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("segment_id")).withColumns(key)
    return sessions.absent(segments, stored)


def embedding_fill(spark: SparkSession, sf: str) -> DataFrame:
    out = sessions.fill(_missing(spark, sf), sessions.hashing_embedder(64), 64)
    return out.select("segment_id", "input_hash", "valid", F.size("embedding").alias("dims"))


def embedding_report(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible, existing and filled segments."""
    filled = embedding_fill(spark, sf).agg(F.count_if("valid").alias("indexed"))
    total = views.table(spark, sf, "conversations").agg(F.count_if(F.trim("text") != "").alias("eligible"))
    return total.crossJoin(filled).select("eligible", (F.col("eligible") - F.col("indexed")).alias("existing"), "indexed")


def quality_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary and range checks, unique keys and ownership over several tables."""
    get = lambda n: views.table(spark, sf, n)
    lines, orders = get("lineitem"), get("orders")
    found = [
        sessions.violations(lines.withColumn("k", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))), "lineitem", "k", {"quantity": F.col("l_quantity") <= 49, "discount": F.col("l_discount").between(0, 0.09), "flag": F.col("l_returnflag").isin("A", "N", "R")}),
        sessions.violations(orders, "orders", "o_orderkey", {"status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice") >= 0}),
        sessions.repeated_keys(lines, "lineitem", ["l_orderkey", "l_linenumber"]),
        sessions.orphans(orders, get("customer").where("c_custkey % 100 <> 0"), "orders", "o_custkey", "c_custkey", "o_orderkey"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_CHILD = "kids AS (SELECT DISTINCT a.conv_id % 2 AS workspace_id, b.conv_id AS source, a.conv_id AS target FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id // 3 AND b.conv_id % 2 = a.conv_id % 2 AND a.conv_id <> b.conv_id)"
_PART = "tp AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'tool_call' WHEN role = 'user' AND turn > 0 THEN 'tool_result' ELSE 'text' END AS part_type, conv_id || '-' || ((turn + 1) // 2) AS call_id FROM conversations), tr AS (SELECT *, sum((part_type = 'text')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM tp)"
_FIND = "fi AS (SELECT conv_id, turn, role, 'k' || CASE WHEN conv_id % 9 = 4 THEN turn // 2 ELSE turn END AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations), dup AS (SELECT conv_id, key FROM fi GROUP BY 1, 2 HAVING count(*) > 1), edg AS (SELECT f.conv_id, f.key, t.key AS target FROM fi f LEFT JOIN (SELECT DISTINCT conv_id, key FROM fi) t ON t.conv_id = f.conv_id AND t.key = 'k' || (f.turn - 1) WHERE f.turn > 0), vio AS (SELECT conv_id, 'duplicate_key' AS code FROM dup UNION ALL SELECT conv_id, CASE WHEN target IS NULL THEN 'unknown_target' ELSE 'self_edge' END FROM edg WHERE target IS NULL OR target = key)"
_CTX = f"""{events._CLAIMS}, {events._RAW},
cl AS (SELECT workspace_id, string_agg(CASE WHEN state IN ('supported', 'contradicted') THEN '[' || state || ']' ELSE '[claim]' END || ' claim ' || claim_key || ' (' || round(confidence * 100)::BIGINT || '%)', chr(10) ORDER BY rk) AS claims
  FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY confidence DESC, 'claim ' || claim_key) AS rk FROM cc QUALIFY rk <= 8) GROUP BY 1),
en AS (SELECT workspace_id, string_agg(s_name || ': context://' || s_suppkey, chr(10) ORDER BY rk) AS entries FROM (SELECT 'w' || (s_suppkey % 4) AS workspace_id, *, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_acctbal DESC, s_name) AS rk FROM supplier WHERE s_suppkey % 3 = 0 QUALIFY rk <= 6) GROUP BY 1),
ev AS (SELECT workspace_id, string_agg(strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || ' codex.' || hook || ' session=' || session_id, chr(10) ORDER BY rk) AS events FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY occurred_at DESC, raw_event_id DESC) AS rk FROM raw QUALIFY rk <= 5) GROUP BY 1),
ctx AS (SELECT w.workspace_id, CASE WHEN w.workspace_id = 'w1' THEN 'the first' ELSE 'No workspace profile summary yet.' END AS profile, coalesce(claims, 'No current claims projected yet.') AS claims, coalesce(entries, 'No Context Index entries pinned yet.') AS entries, coalesce(ev.events, 'No recent raw events captured yet.') AS events
  FROM (SELECT DISTINCT workspace_id FROM raw) w LEFT JOIN cl USING (workspace_id) LEFT JOIN en USING (workspace_id) LEFT JOIN ev USING (workspace_id))"""
_MISSING = "mis AS (SELECT conv_id * 8 + turn AS segment_id, text FROM conversations WHERE trim(text) <> '' AND conv_id * 8 + turn NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0))"

ORACLES = {
    "tool_runs": f"WITH {_PART} SELECT conv_id AS session_id, turn AS ordinal, part_type, run FROM tr WHERE part_type <> 'text'",
    "turn_segments": f"""WITH {_PART}, pr AS (SELECT conv_id, call_id, min(turn) FILTER (part_type = 'tool_call') AS a, min(turn) FILTER (part_type = 'tool_result') AS b FROM tr WHERE part_type <> 'text' GROUP BY conv_id, run, call_id HAVING count(*) FILTER (part_type = 'tool_call') = 1 AND count(*) FILTER (part_type = 'tool_result') = 1 AND a < b),
      t AS (SELECT tr.*, c.text AS body, CASE WHEN part_type = 'text' THEN c.text ELSE 'run ' || c.text || ' ok' END AS text FROM tr JOIN conversations c USING (conv_id, turn)),
      s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({documents._CLEAN}, '\\r\\n', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS st FROM t),
      g AS (SELECT s.conv_id AS session_id, turn AS ordinal, part_type, st, pr.call_id AS group_call, a, b, body FROM s LEFT JOIN pr ON pr.conv_id = s.conv_id AND turn IN (a, b)),
      f AS (SELECT *, CASE WHEN st = '' THEN CASE WHEN group_call IS NULL THEN 'turn_skipped' ELSE 'tool_group_skipped' END WHEN group_call IS NULL THEN 'turn' WHEN part_type = 'tool_call' THEN 'tool_group_call' ELSE 'tool_group_result' END AS segment_kind, length(regexp_replace(st, '\\s+$', '')) AS stop FROM g)
      SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS segment, ordinal, segment_kind, CASE WHEN st <> '' THEN 1 END::BIGINT AS chunk_count, CASE WHEN st <> '' THEN length(st) - length(regexp_replace(st, '^\\s+', '')) END AS char_start, CASE WHEN st <> '' THEN stop END AS char_end,
        md5(trim(st)) AS digest, part_type AS part_types, '' AS reasons, group_call, CASE ordinal WHEN a THEN 0 WHEN b THEN 1 END::BIGINT AS member_index, a || ',' || b AS group_ordinals, CASE WHEN st <> '' THEN ordinal * 10000 + length(body) END AS raw_end FROM f""",
    "tool_pairs": f"WITH {_PART} SELECT conv_id AS session_id, run, call_id, min(turn) FILTER (part_type = 'tool_call') AS call_at, min(turn) FILTER (part_type = 'tool_result') AS result_at FROM tr WHERE part_type <> 'text' GROUP BY 1, 2, 3 HAVING count(*) FILTER (part_type = 'tool_call') = 1 AND count(*) FILTER (part_type = 'tool_result') = 1 AND call_at < result_at",
    "skipped_summary": """WITH s AS (SELECT conv_id AS session_id, turn AS ordinal, length(text) AS n, CASE WHEN length(text) > 400 THEN 'huge_raw_log' WHEN length(text) < 100 THEN 'secret' END AS reason, CASE WHEN role = 'user' THEN 'turn_skipped' ELSE 'tool_group_skipped' END AS kind FROM conversations)
      SELECT session_id, ordinal, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n_skipped, sum(n)::BIGINT AS n_chars, '{"type":"omitted","reasons":["' || string_agg(DISTINCT reason, '","' ORDER BY reason) || '"],"count":' || count(*) || '}' AS placeholder FROM s WHERE reason IS NOT NULL GROUP BY 1, 2""",
    "session_detail": "SELECT conv_id AS session_id, count(*) AS n_turns, count(*) > 5 AS truncated, string_agg(turn || ':' || role, ',' ORDER BY turn) FILTER (rn <= 5) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1",
    "session_bounds": "SELECT conv_id AS session_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1",
    "capped_segments": "WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents), c AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n <= 1200 THEN 1 ELSE greatest(2, ceil((n - 125) / 875.0))::INT END AS k FROM n) SELECT doc_id AS turn_id, unnest(range(0, least(k, 2)))::INT AS ordinal, k > 2 AS truncated FROM c",
    "lineage": "WITH e AS (SELECT DISTINCT a.conv_id AS source, a.conv_id + 1 AS target FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 5 <> 4) SELECT node, (node // 5) * 5 + coalesce((SELECT max(k) FROM range(1, 5) t(k) WHERE k <= node % 5 AND (node // 5) * 5 + k - 1 NOT IN (SELECT source FROM e)), 0) AS lineage FROM (SELECT source AS node FROM e UNION SELECT target FROM e)",
    "continuations": "WITH a AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 AND turn % 2 = 1 THEN conv_id - 2 ELSE conv_id - 1 END AS anchor FROM conversations), o AS (SELECT conv_id, min(anchor) AS source FROM a GROUP BY 1 HAVING min(anchor) = max(anchor)) SELECT source, conv_id AS target FROM o WHERE source IN (SELECT conv_id FROM conversations)",
    "relationships": f"WITH {_CHILD} SELECT * FROM kids",
    "edge_reconcile": f"WITH {_CHILD} SELECT source, target, CASE WHEN target % 2 <> 0 THEN 'insert' WHEN target % 10 = 0 THEN 'foreign' ELSE 'keep' END AS action FROM kids UNION ALL SELECT source, target + 1000000, 'delete' FROM kids WHERE target % 4 = 1",
    "consolidation_violations": f"WITH {_FIND} SELECT conv_id::VARCHAR AS record_id, code, count(*) AS n FROM vio GROUP BY 1, 2",
    "consolidation_load": f"WITH {_FIND} SELECT conv_id::VARCHAR AS record_id, ordinal::INT AS ordinal, key, CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'decision' ELSE 'learning' END AS type FROM fi WHERE conv_id NOT IN (SELECT conv_id FROM vio)",
    "record_details": f"WITH {_FIND} SELECT conv_id::VARCHAR AS record_id, count(*) AS n_findings, string_agg(key || '|' || CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'decision' ELSE 'learning' END || '|' || conv_id || '/' || turn, ',' ORDER BY ordinal) AS findings FROM fi WHERE conv_id NOT IN (SELECT conv_id FROM vio) GROUP BY 1",
    "context_document": f"WITH RECURSIVE {_CTX} SELECT * FROM ctx",
    "context_markdown": f"""WITH RECURSIVE {_CTX}, b AS (SELECT *, chr(10) || '- ' AS nl FROM ctx) SELECT workspace_id, '# Active Context for ' || workspace_id || chr(10) || chr(10) || 'Generated: {events.AS_OF}' || chr(10) || chr(10)
      || '## Workspace Profile' || chr(10) || nl || profile || chr(10) || chr(10) || '## Current Claims' || chr(10) || nl || replace(claims, chr(10), nl) || chr(10) || chr(10) || '## Context Index' || chr(10) || nl || replace(entries, chr(10), nl) || chr(10) || chr(10) || '## Recent Activity' || chr(10) || nl || replace(events, chr(10), nl) AS markdown FROM b""",
    "context_links": "SELECT 'w' || (p_partkey % 4) AS workspace_id, p_name || ' ' || p_partkey AS key, 'context://' || replace(url_encode(p_name || ' ' || p_partkey), '%20', '+') AS link, p_name || ' ' || p_partkey AS resolved_key FROM part WHERE p_partkey % 4 <> 3",
    "session_erasure": f"WITH {events._LABELLED} SELECT 'raw_events' AS \"table\", session_id, count(*) AS n FROM raw WHERE session_id::BIGINT % 10 = 0 GROUP BY 2 UNION ALL SELECT 'activity_intervals', session_id, count(*) FROM ivals WHERE session_id::BIGINT % 10 = 0 GROUP BY 2",
    "event_association": "SELECT user_id::VARCHAR AS session_id, event_id AS raw_event_id FROM events WHERE user_id % 10 = 0 UNION SELECT a.user_id::VARCHAR, b.event_id FROM events a JOIN events b ON b.event_id IN (a.event_id + 1, a.event_id + 2) WHERE a.event_id % 100 = 0 AND a.user_id % 10 = 0",
    "hard_redaction": """WITH s AS (SELECT source || '/' || (doc_id % 37) AS session_id, doc_id AS captured, text, contains(text, 'token') AS hit FROM documents), t AS (SELECT *, bool_or(hit) OVER w AS h, max(captured) OVER w AS newest FROM s WINDOW w AS (PARTITION BY session_id))
      SELECT session_id, captured, CASE WHEN h THEN 'emptied' ELSE 'captured' END AS status, captured = newest AND NOT h AS is_active, CASE WHEN NOT h THEN md5(text) END AS digest FROM t UNION ALL SELECT session_id, captured + 1, 'redacted', true, md5(replace(text, 'token', '[key]')) FROM t WHERE h AND captured = newest""",
    "embedding_absence": f"WITH {_MISSING} SELECT segment_id FROM mis",
    "embedding_report": f"WITH {_MISSING} SELECT (SELECT count(*) FROM conversations WHERE trim(text) <> '') AS eligible, (SELECT count(*) FROM conversations WHERE trim(text) <> '') - count(*) AS existing, count(*) AS indexed FROM mis",
    "quality_violations": """SELECT 'lineitem' AS "table", unnest(list_filter([CASE WHEN NOT l_quantity <= 49 THEN 'quantity' END, CASE WHEN NOT l_discount BETWEEN 0 AND 0.09 THEN 'discount' END, CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'flag' END], lambda x: x IS NOT NULL)) AS rule, l_orderkey || '/' || l_linenumber AS key FROM lineitem
      UNION ALL SELECT 'orders', unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN NOT o_totalprice >= 0 THEN 'price' END], lambda x: x IS NOT NULL)), o_orderkey::VARCHAR FROM orders
      UNION ALL SELECT 'lineitem', 'unique', l_orderkey || '/' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
      UNION ALL SELECT 'orders', 'parent', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 100 <> 0)""",
}

QUERIES = {name: globals()[name] for name in [*ORACLES, "embedding_fill"]}
