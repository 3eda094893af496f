"""Redaction by tables of patterns, and of whole sessions through all tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns, redaction
from ..sources import views

TABLE = "position long, kind string, pattern string, replacement string, flags string"


def pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    """All words of eight letters and more of the benchmark's items, longest first, as literals over all documents."""
    words = views.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("pattern")).distinct()
    # a longer word goes before its own parts: the order is by length, then by the word, as one sortable number
    ranked = words.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.length("pattern")).alias("n"), "pattern"))).alias("w")).select(F.posexplode("w").alias("position", "w"))
    table = ranked.select(F.col("position").cast("long").alias("position"), F.lit("literal").alias("kind"), F.col("w.pattern").alias("pattern"), F.lit("[#]").alias("replacement"), F.lit("").alias("flags"))
    text, _ = patterns.redactor(table)
    rows = views.table(spark, sf, "documents").select("doc_id", text(F.col("text")).alias("r"))
    return rows.select("doc_id", F.col("r.n").alias("n"), F.md5("r.text").alias("digest"))


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A session per user: its events, each naming the one before; a document of the same number as its body, and for every
    fifth an older body that is what redaction would make of it."""
    events = views.raw_events(views.table(spark, sf, "events"))
    payload = F.to_json(F.struct(F.concat(F.lit("user-"), "session_id").alias("who"), F.struct(F.col("raw_event_id").alias("n"), F.array(F.col("external_event_id")).alias("ids")).alias("in")))
    events = events.select("workspace_id", "session_id", "raw_event_id", "external_event_id", "source_id", F.col("session_id").alias("session_ref"), payload.alias("payload"))
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"), (F.col("doc_id") * 10).alias("captured"), F.col("text").alias("content"))
    older = docs.where("captured % 50 = 0").select("session_id", (F.col("captured") - 1).alias("captured"), F.replace("content", F.lit("69"), F.lit("[n]")).alias("content"))
    named = events.select("raw_event_id", (F.col("raw_event_id") - 1).cast("string").alias("external_id"))
    claim_events = views.claim_events(views.table(spark, sf, "events")).select("workspace_id", "claim_key", F.col("seq").alias("raw_event_id"))
    claims = claim_events.select("workspace_id", "claim_key").distinct()
    return {"snapshots": docs.unionByName(older), "events": events, "references": named, "claim_events": claim_events, "claims": claims}


def session_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions with an event are redacted by one literal; the rows of all tables afterwards, as one table."""
    tables = _tables(spark, sf)
    table = spark.createDataFrame([(0, "literal", "69", "[n]", "")], TABLE)
    out = redaction.redact_sessions(tables, table, tables["events"])
    row = lambda df, kind, id_, a, b, n: df.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), a.alias("a"), b.alias("b"), n.cast("long").alias("n"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    parts = [
        row(out["events"], "event", "raw_event_id", F.concat_ws("|", "external_event_id", "source_id", "session_ref"), F.col("payload"), F.col("hits")),
        row(out["references"], "reference", "raw_event_id", F.col("external_id"), none, zero),
        row(out["claims"], "claim", "claim_key", F.col("workspace_id"), none, zero),
        row(out["claim_events"], "claim_event", "raw_event_id", none, none, F.col("redacted").cast("int")),
        row(out["snapshots"], "snapshot", "session_id", F.col("status"), F.md5("content"), F.col("captured")),
        row(out["errors"], "error", "session_id", F.col("code"), none, zero),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_HITS = "(length({0}) - length(replace({0}, '69', ''))) // 2"
ORACLES = {
    "pattern_table": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS p FROM benchmark), l AS (SELECT list(p ORDER BY -length(p), p) AS ps FROM w),
      r AS (SELECT doc_id, list_reduce(list_prepend(text, ps), lambda a, p: replace(a, p, '[#]')) AS t FROM documents, l)
      SELECT doc_id, ((length(t) - length(replace(t, '[#]', ''))) // 3)::BIGINT AS n, md5(t) AS digest FROM r""",
    "session_redaction": f"""WITH e AS (SELECT 'w' || (user_id % 4) AS w, user_id::VARCHAR AS s, event_id AS id, event_id::VARCHAR AS x, user_id AS claim FROM events),
      h AS (SELECT *, ({_HITS.format("x")}) * 2 + ({_HITS.format("s")}) * 2 AS n FROM e),
      shots AS (SELECT doc_id::VARCHAR AS s, doc_id * 10 AS captured, text AS content FROM documents UNION ALL SELECT doc_id::VARCHAR, doc_id * 10 - 1, replace(text, '69', '[n]') FROM documents WHERE doc_id * 10 % 50 = 0),
      last AS (SELECT DISTINCT ON (s) s, captured, replace(content, '69', '[n]') AS content, coalesce({_HITS.format("content")}, 0) AS n FROM shots WHERE s IN (SELECT s FROM e) ORDER BY s, captured DESC),
      st AS (SELECT c.s, coalesce(l.n, 0) AS body, c.n AS ev, coalesce(l.n > 0 AND l.content IN (SELECT content FROM shots z WHERE z.s = c.s), false) AS same FROM (SELECT s, sum(n) AS n FROM h GROUP BY s) c LEFT JOIN last l ON l.s = c.s),
      co AS (SELECT *, CASE WHEN body + ev = 0 THEN 'no_match' WHEN same THEN 'repeated_hash' END AS code FROM st),
      ev AS (SELECT h.*, h.n > 0 AND co.code IS NULL AS done FROM h JOIN co ON co.s = h.s),
      gone AS (SELECT * FROM ev WHERE done),
      moved AS (SELECT id, CASE WHEN done AND contains(x, '69') THEN 'redacted:' || id || ':external-event' ELSE x END AS x FROM ev)
      SELECT 'event' AS kind, ev.id::VARCHAR AS id, moved.x || '|codex:local|' || CASE WHEN done THEN replace(s, '69', '[n]') ELSE s END AS a,
        CASE WHEN done THEN '{{"who":"user-' || replace(s, '69', '[n]') || '","in":{{"n":' || ev.id || ',"ids":["' || replace(ev.x, '69', '[n]') || '"]}}}}' ELSE '{{"who":"user-' || s || '","in":{{"n":' || ev.id || ',"ids":["' || ev.x || '"]}}}}' END AS b,
        CASE WHEN done THEN n ELSE 0 END::BIGINT AS n FROM ev JOIN moved ON moved.id = ev.id
      UNION ALL SELECT 'reference', e.id::VARCHAR, coalesce(m.x, (e.id - 1)::VARCHAR), NULL, 0 FROM e LEFT JOIN moved m ON m.id = e.id - 1
      UNION ALL SELECT DISTINCT 'claim', claim::VARCHAR, w, NULL, 0 FROM e WHERE claim NOT IN (SELECT claim FROM gone)
      UNION ALL SELECT 'claim_event', id::VARCHAR, NULL, NULL, done::INT FROM ev
      UNION ALL SELECT 'snapshot', shots.s, CASE WHEN co.body > 0 AND co.code IS NULL THEN 'redacted' ELSE 'captured' END, CASE WHEN co.body > 0 AND co.code IS NULL THEN NULL ELSE md5(content) END, captured FROM shots LEFT JOIN co ON co.s = shots.s
      UNION ALL SELECT 'snapshot', last.s, 'redacted', md5(content), captured + 1 FROM last JOIN co ON co.s = last.s WHERE body > 0 AND code IS NULL
      UNION ALL SELECT 'error', s, code, NULL, 0 FROM co WHERE code IS NOT NULL""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
