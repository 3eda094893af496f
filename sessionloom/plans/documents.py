"""Queries over snapshots, texts and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import snapshots
from ..sources import views


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents")


def snapshot_history(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.history(views.snapshots(_docs(spark, sf)))


def visible_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with every fourth redacted: active ones stay visible."""
    rows = snapshot_history(spark, sf).withColumn("status", F.when(F.col("captured") % 4 == 0, "redacted").otherwise("captured"))
    return snapshots.visible(rows).groupBy("session_id").agg(F.count("*").alias("n_visible"))


def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against themselves with some ids missing on either side and some texts edited."""
    docs = _docs(spark, sf).select("doc_id", "text", "lang")
    stored = docs.where("doc_id % 10 <> 1")
    fresh = docs.where("doc_id % 10 <> 2").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return snapshots.changes(stored, fresh, ["doc_id"])


def rederive_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the sessions with a changed snapshot are rebuilt, the others kept."""
    docs = _docs(spark, sf)
    stored = docs.select(F.col("source").alias("session_id"), "doc_id", F.lit("old").alias("version"))
    fresh = docs.select(F.col("source").alias("session_id"), "doc_id", F.lit("new").alias("version"))
    return snapshots.rederive(stored, docs.where("doc_id % 50 = 7").select(F.col("source").alias("session_id")), fresh)


def home_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of a content is the one of its first capture: blocks of 100 captures here."""
    shots = views.snapshots(_docs(spark, sf))
    spans = shots.select("session_id", F.col("captured").alias("first_captured"), F.floor(F.col("captured") / 100).alias("home_ordinal")).distinct()
    out = snapshots.home_intervals(snapshots.history(shots), shots, spans)
    return out.select("session_id", "captured", "first_captured", "home_ordinal")


def body_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as JSON bodies, a third of them cut short, a third as two JSONL lines."""
    events = views.table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("json"), F.lit("jsonl"), F.lit("text")), (F.col("event_id") % 3 + 1).cast("int"))
    body = F.when(kind == "jsonl", F.concat_ws("\n", "props", F.lit(""), "props")).otherwise(F.col("props"))
    body = F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(body)
    rows = snapshots.body_validity(events.select("event_id", kind.alias("content_type"), body.alias("body")), "body", "content_type")
    return rows.select("event_id", "content_type", "valid")


def session_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Documents resolve to sessions made of every other document: by id, by locator, or new."""
    docs = _docs(spark, sf)
    place = F.sha2(F.concat(F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 4).cast("string")), 256)
    sessions = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("session"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("h"), F.col("doc_id").cast("string"))).alias("harness_session_id"), place.alias("locator_hash"))
    incoming = docs.select("doc_id", F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("harness_session_id"), place.alias("locator_hash"))
    return snapshots.resolve_sessions(incoming, sessions).select("doc_id", "session", "how")


def fallback_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.length(T.fallback_text(F.col("text"))).alias("n"), F.md5(T.fallback_text(F.col("text"))).alias("digest"))


def search_text(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned and normalised texts with their snippets."""
    rows = _docs(spark, sf).withColumn("s", T.normalize(T.clean(F.col("text"))))
    return rows.select("doc_id", F.length("s").alias("n"), F.md5("s").alias("digest"), T.snippet(F.col("s")).alias("snippet"))


def part_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as content parts of three types."""
    turns = views.turns(views.table(spark, sf, "conversations"))
    kind = F.when(F.col("role") == "assistant", "tool_call").when(F.col("role") == "user", "tool_result").otherwise("text")
    part = F.struct(kind.alias("type"), F.when(kind == "text", F.col("text")).alias("text"), F.lit("run").alias("name"), F.when(kind == "tool_call", F.col("text")).alias("arguments"), F.when(kind == "tool_result", F.col("text")).alias("output"), F.lit("ok").alias("status"))
    return turns.select("session_id", "ordinal", part.alias("part")).select("session_id", "ordinal", T.part_text(F.col("part")).alias("search_text"))


def noise_measures(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return docs.select("doc_id", *[c.alias(k) for k, c in T.measures(F.col("text")).items()])


def filter_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds lowered so that each reason occurs in the given texts."""
    reason = T.filter_reason(F.col("text"), long_chars=12_000, many_lines=40, log_lines=10, diff_lines=5, diff_chars=3_000, diff_share=0.02, generated_chars=500, repeated_lines=3, distinct_share=0.6)
    return _docs(spark, sf).select("doc_id", reason.alias("reason"))


KEYS = ("token", "secret", "password", "passwd", "pwd", "api[_-]?key")


def secret_masking(spark: SparkSession, sf: str) -> DataFrame:
    """Secret lines go; the key list is a parameter and includes ``token`` here."""
    kept = T.drop_secret_lines(F.col("text"), KEYS)
    return _docs(spark, sf).select("doc_id", (F.size(T.lines(F.col("text"))) - F.when(kept == "", 0).otherwise(F.size(T.lines(kept)))).alias("n_dropped"), F.md5(kept).alias("digest"))


def structured_masking(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted keys in event properties, with one secret key put in."""
    props = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "password" : "'), F.col("event_type"), F.lit('"}'))
    return views.table(spark, sf, "events").select("event_id", T.mask_structured(props).alias("masked"))


PATTERNS = (("token", "[key]", True), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[mail]", False), (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[ip]", False))


def pattern_redaction(spark: SparkSession, sf: str) -> DataFrame:
    text, hits = T.redact_patterns(F.col("text"), PATTERNS)
    return _docs(spark, sf).select("doc_id", hits.alias("n_hits"), F.md5(text).alias("digest"))


def path_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses beside local paths made of them: the addresses stay, the paths go."""
    pages = views.table(spark, sf, "pages")
    line = F.concat(F.lit("see "), F.col("url"), F.lit(" in /home/user"), (F.col("page_id") % 10).cast("string"), F.lit("/notes.txt and C:\\data\\x"), F.col("page_id").cast("string"))
    return pages.select("page_id", T.redact_paths(line).alias("redacted"))


def locator_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages")
    locator = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("file:///srv/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(" x"))).otherwise(F.col("url"))
    return pages.select("page_id", T.safe_locator(locator).alias("locator"))


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping token chunks with dense ordinals."""
    rows = _docs(spark, sf).withColumn("t", T.tokens(F.col("text")))
    rows = rows.select("doc_id", "t", F.posexplode(T.chunk_bounds(F.size("t"))).alias("ordinal", "b"))
    chunk = F.slice("t", F.col("b.token_start") + 1, F.col("b.token_end") - F.col("b.token_start"))
    return rows.select("doc_id", "ordinal", "b.token_start", "b.token_end", F.md5(F.array_join(chunk, " ")).alias("digest"))


def metadata_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties with bookkeeping keys merged in and pruned again; new keys win."""
    extra = F.create_map(F.lit("bundle"), F.col("event_type"), F.lit("kind"), F.col("event_type"))
    merged = F.map_concat(F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "kind"), extra)
    pruned = F.map_filter(merged, lambda k, v: ~k.isin("bundle", "snapshot"))
    rows = views.table(spark, sf, "events").select("event_id", pruned.alias("m"))
    return rows.select("event_id", F.col("m")["kind"].alias("kind"), F.size("m").alias("n_keys"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


def recent_records(spark: SparkSession, sf: str) -> DataFrame:
    """The newest snapshots with counts of their session's snapshots and chunks: children are aggregated first."""
    docs = _docs(spark, sf)
    chunks = docs.select("source", F.size(T.chunk_bounds(F.size(T.tokens(F.col("text"))))).alias("k")).groupBy("source").agg(F.sum("k").alias("n_chunks"), F.count("*").alias("n_snapshots"))
    top = docs.select("doc_id", "source").orderBy(F.col("doc_id").desc()).limit(20)
    return top.join(chunks, "source", "left").select("doc_id", "source", "n_snapshots", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """One column for each family of scalar functions."""
    events = views.table(spark, sf, "events")
    return events.select(
        "event_id",
        F.upper(F.substring("event_type", 1, 3)).alias("head"),
        F.locate("i", F.col("event_type")).alias("at"),
        F.concat(F.lit("sha256:"), F.sha2("props", 256)).alias("digest"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value"))).alias("clamped"),
        F.ceil(F.col("value") / 7).alias("chunks"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.nullif(F.trim(F.regexp_replace("event_type", "[aeiou]", "")), F.lit("")).alias("consonants"),
        F.url_encode(F.concat(F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"))).alias("link"),
    )


_LINES = r"string_split_regex(text, '\r?\n')"
_SPACE = r"\t\n\x0B\f\r "


def _dup_hist() -> str:
    return "h0 AS (SELECT source AS session_id, 'sha256:' || sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS captured FROM documents GROUP BY 1, 2), hist AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY captured) - 1)::INT AS snapshot_ordinal, captured = max(captured) OVER (PARTITION BY session_id) AS is_active FROM h0)"


_TOK = "tk AS (SELECT doc_id, source, regexp_extract_all(text, '\\S+') AS t FROM documents), tn AS (SELECT *, len(t) AS n, greatest(2, ceil((len(t) - 125) / 875.0)) AS c FROM tk), ts AS (SELECT *, CASE WHEN n <= 1200 THEN n ELSE least(1200, greatest(800, ceil((n + 125 * (c - 1)) / c)))::BIGINT END AS size FROM tn), tb AS (SELECT *, CASE WHEN n <= 1200 THEN greatest(n, 1) ELSE size - 125 END AS stride FROM ts), tc AS (SELECT doc_id, source, t, n, size, unnest(list_filter(range(0, n, stride), lambda s: s = 0 OR s - stride + size < n)) AS a FROM tb WHERE n > 0), chunks AS (SELECT doc_id, source, t, a, least(a + size, n) AS b FROM tc)"
_MEASURES = f"""m AS (SELECT doc_id, text, length(text)::INT AS n_chars, len({_LINES})::INT AS n_lines, len(regexp_extract_all(text, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]'))::INT AS n_control,
  len(regexp_extract_all(text, '\\s'))::DOUBLE / greatest(length(text), 1) AS blank_ratio, len(regexp_extract_all(text, '[A-Za-z0-9+/]{{80,}}'))::INT AS n_base64,
  len(list_filter({_LINES}, lambda x: regexp_matches(trim(x), '^(?:\\[[^\\]]+\\]|\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]|\\w+:\\s|at\\s+\\S+\\s+\\()')))::DOUBLE / greatest(len({_LINES}), 1) AS log_ratio,
  len(list_filter({_LINES}, lambda x: regexp_matches(x, '^(?:diff --git|index [a-f0-9]|@@ |\\+\\+\\+ |--- |\\+|-)')))::DOUBLE / greatest(len({_LINES}), 1) AS diff_ratio,
  len(list_filter({_LINES}, lambda x: trim(x) <> ''))::INT AS n_filled,
  len(list_distinct(list_filter(list_transform({_LINES}, lambda x: trim(x)), lambda x: x <> '')))::DOUBLE / greatest(len(list_filter({_LINES}, lambda x: trim(x) <> '')), 1) AS distinct_ratio FROM documents)"""
_CLEAN = f"trim(list_aggregate(list_filter(string_split_regex(regexp_replace(text, '\\x1B\\[[0-9;]*m', '', 'g'), '\\r?\\n'), lambda x: NOT regexp_matches(trim(x), '^(Exit code:|Wall time:|Output:)(\\W|$)')), 'string_agg', chr(10)))"

ORACLES = {
    "snapshot_history": f"WITH {_dup_hist()} SELECT * FROM hist",
    "visible_snapshots": f"WITH {_dup_hist()} SELECT session_id, count(*) AS n_visible FROM hist WHERE is_active OR captured % 4 <> 0 GROUP BY 1",
    "change_detection": "SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 10 = 2 THEN 'gone' WHEN doc_id % 10 = 3 THEN 'changed' ELSE 'same' END AS state FROM documents",
    "rederive_changed": "SELECT source AS session_id, doc_id, CASE WHEN source IN (SELECT source FROM documents WHERE doc_id % 50 = 7) THEN 'new' ELSE 'old' END AS version FROM documents",
    "home_interval": f"WITH {_dup_hist()} SELECT d.source AS session_id, d.doc_id AS captured, h.captured AS first_captured, h.captured // 100 AS home_ordinal FROM documents d JOIN hist h ON h.session_id = d.source AND h.content_hash = 'sha256:' || sha256(coalesce(d.text, ''))",
    "body_validity": "SELECT event_id, ['json', 'jsonl', 'text'][event_id % 3 + 1] AS content_type, CASE WHEN event_id % 3 = 2 THEN true ELSE event_id % 7 <> 0 END AS valid FROM events",
    "session_resolve": """WITH s AS (SELECT doc_id AS session, CASE WHEN doc_id % 4 = 0 THEN 'h' || doc_id END AS h, source || '/' || (doc_id // 4) AS p FROM documents WHERE doc_id % 2 = 0),
      p AS (SELECT p, min(session) AS session FROM s WHERE h IS NULL GROUP BY 1)
      SELECT d.doc_id, coalesce(a.session, p.session) AS session, CASE WHEN a.session IS NOT NULL THEN 'id' WHEN p.session IS NOT NULL THEN 'adopted' ELSE 'new' END AS how
      FROM documents d LEFT JOIN s a ON a.h = 'h' || d.doc_id LEFT JOIN p ON p.p = d.source || '/' || (d.doc_id // 4)""",
    "fallback_texts": "WITH f AS (SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 4000) AS s FROM documents) SELECT doc_id, length(s)::INT AS n, md5(s) AS digest FROM f",
    "search_text": f"WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '\\r\\n', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS s FROM documents), g AS (SELECT *, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS p FROM f) SELECT doc_id, length(s)::INT AS n, md5(s) AS digest, CASE WHEN length(p) <= 240 THEN p ELSE substr(p, 1, 239) || '...' END AS snippet FROM g",
    "part_texts": "SELECT conv_id AS session_id, turn AS ordinal, CASE WHEN role = 'assistant' OR role = 'user' THEN concat_ws(' ', 'run', CASE WHEN text <> '' THEN text END, 'ok') ELSE text END AS search_text FROM conversations",
    "noise_measures": f"WITH {_MEASURES} SELECT * EXCLUDE (text) FROM m",
    "filter_reasons": f"""WITH {_MEASURES} SELECT doc_id, CASE WHEN contains(text, chr(0)) OR (n_control > 20 AND n_control / greatest(n_chars, 1) > 0.02) OR (length(regexp_replace(text, '\\s+', '', 'g')) > 300 AND blank_ratio < 0.02 AND regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '^[A-Za-z0-9+/=]+$')) OR regexp_matches(text, '(?:[A-Za-z0-9+/]{{80,}}={{0,2}}\\s*){{3,}}') THEN 'binary_or_base64'
      WHEN n_chars > 12000 OR n_lines > 40 OR (n_lines > 10 AND log_ratio > 0.7) THEN 'huge_raw_log' WHEN (n_lines > 5 OR n_chars > 3000) AND diff_ratio > 0.02 THEN 'unbounded_diff'
      WHEN n_chars >= 500 AND (regexp_matches(text, '(?i)\\b(?:generated|auto-generated|do not edit|routeTree\\.gen|package-lock\\.json|pnpm-lock\\.yaml|yarn\\.lock)\\b') OR (n_filled >= 3 AND distinct_ratio < 0.6)) THEN 'repeated_generated_file' END AS reason FROM m""",
    "secret_masking": f"""WITH f AS (SELECT doc_id, text, list_filter({_LINES}, lambda x: NOT (regexp_matches(x, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(x, '\\b(?:sk-[A-Za-z0-9_-]{{20,}}|ghp_[A-Za-z0-9_]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}})\\b') OR regexp_matches(x, '\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b')
      OR regexp_matches(replace(x, '[REDACTED]', ','), '(?i)["'']?\\b(?:token|secret|password|passwd|pwd|api[_-]?key)\\b["'']?\\s*[:=]\\s*["'']?[^\\s"'',}}\\]]{{8,}}'))) AS k FROM documents)
      SELECT doc_id, (len({_LINES}) - CASE WHEN coalesce(array_to_string(k, chr(10)), '') = '' THEN 0 ELSE len(k) END)::INT AS n_dropped, md5(coalesce(array_to_string(k, chr(10)), '')) AS digest FROM f""",
    "structured_masking": """SELECT event_id, substr(props, 1, length(props) - 1) || ', "password":"[REDACTED]"}' AS masked FROM events""",
    "pattern_redaction": """WITH a AS (SELECT doc_id, (length(text) - length(replace(text, 'token', ''))) / 5 AS n1, replace(text, 'token', '[key]') AS t FROM documents),
      b AS (SELECT doc_id, n1, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS n2, regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[mail]', 'g') AS t FROM a),
      c AS (SELECT doc_id, n1, n2, len(regexp_extract_all(t, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b')) AS n3, regexp_replace(t, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '[ip]', 'g') AS t FROM b)
      SELECT doc_id, (n1 + n2 + n3)::INT AS n_hits, md5(t) AS digest FROM c""",
    "path_redaction": "SELECT page_id, 'see ' || url || ' in [local-path-redacted] and [local-path-redacted]' AS redacted FROM pages",
    "locator_sanitize": "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN url END AS locator FROM pages",
    "text_chunks": f"WITH {_TOK} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS ordinal, a::INT AS token_start, b::INT AS token_end, md5(array_to_string(t[a + 1 : b], ' ')) AS digest FROM chunks",
    "metadata_prune": "SELECT event_id, event_type AS kind, (len(json_keys(props)) + 1)::INT AS n_keys, array_to_string(list_sort(list_append(json_keys(props), 'kind')), ',') AS keys FROM events",
    "recent_records": f"WITH {_TOK}, k AS (SELECT source, count(*) AS n_chunks FROM chunks GROUP BY 1), s AS (SELECT source, count(*) AS n_snapshots FROM documents GROUP BY 1) SELECT doc_id, d.source, n_snapshots, coalesce(n_chunks, 0)::BIGINT AS n_chunks FROM (SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 20) d JOIN s USING (source) LEFT JOIN k USING (source)",
    "scalar_functions": "SELECT event_id, upper(substr(event_type, 1, 3)) AS head, strpos(event_type, 'i')::INT AS at, 'sha256:' || sha256(props) AS digest, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value)) AS clamped, ceil(value / 7)::BIGINT AS chunks, json_extract_string(props, '$.k')::BIGINT AS k, nullif(trim(regexp_replace(event_type, '[aeiou]', '', 'g')), '') AS consonants, url_encode(event_type || '/' || event_id) AS link FROM events",
}

QUERIES = {name: globals()[name] for name in ORACLES}
