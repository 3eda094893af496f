"""Session jobs: tool runs and pairs, skipped content, nested details, context documents, findings, erasure, redaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


# --- tools ----------------------------------------------------------------------------------------------------
def tool_runs(turns: DataFrame) -> DataFrame:
    """Tool turns (part_type other than text) with the number of their contiguous run in the session."""
    w = Window.partitionBy("session_id").orderBy("ordinal")
    rows = turns.withColumn("run", F.sum((F.col("part_type") == "text").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("part_type <> 'text'")


def tool_pairs(runs: DataFrame) -> DataFrame:
    """Unambiguous pairs: one call and one result of an id in a run, the call first."""
    at = lambda kind: F.min(F.when(F.col("part_type") == kind, F.col("ordinal")))
    n = lambda kind: F.count_if(F.col("part_type") == kind)
    found = runs.groupBy("session_id", "run", "call_id").agg(n("tool_call").alias("calls"), n("tool_result").alias("results"), at("tool_call").alias("call_at"), at("tool_result").alias("result_at"))
    return found.where("calls = 1 AND results = 1 AND call_at < result_at").select("session_id", "run", "call_id", "call_at", "result_at")


def skipped_summary(segments: DataFrame) -> DataFrame:
    """Per turn with skipped segments: sorted reasons and kinds, counts, and the placeholder part that replaces the payload."""
    out = segments.where("reason IS NOT NULL").groupBy("session_id", "ordinal").agg(
        F.array_sort(F.collect_set("reason")).alias("reasons"), F.array_sort(F.collect_set("segment_kind")).alias("kinds"), F.count("*").alias("n_skipped"), F.sum("n_chars").alias("n_chars")
    )
    part = F.to_json(F.struct(F.lit("omitted").alias("type"), F.col("reasons"), F.col("n_skipped").alias("count")))
    return out.select("session_id", "ordinal", F.array_join("reasons", ",").alias("reasons"), F.array_join("kinds", ",").alias("kinds"), "n_skipped", "n_chars", part.alias("placeholder"))


# --- details --------------------------------------------------------------------------------------------------
def session_detail(turns: DataFrame, most: int = 5) -> DataFrame:
    """Per session its first turns nested in order, their number and whether there are more."""
    w = Window.partitionBy("session_id").orderBy("ordinal")
    rows = turns.withColumn("rn", F.row_number().over(w))
    return rows.groupBy("session_id").agg(
        F.count("*").alias("n_turns"),
        (F.max("rn") > most).alias("truncated"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("ordinal", "role")))), lambda x: F.concat(x["ordinal"].cast("string"), F.lit(":"), x["role"])), ",").alias("turns"),
    )


def capped(segments: DataFrame, most: int) -> DataFrame:
    """The first segments of each turn and whether the turn has more."""
    w = Window.partitionBy("turn_id").orderBy("ordinal")
    whole = Window.partitionBy("turn_id")
    rows = segments.withColumn("rn", F.row_number().over(w)).withColumn("truncated", F.count("*").over(whole) > most)
    return rows.where(F.col("rn") <= most)


def session_bounds(turns: DataFrame) -> DataFrame:
    """Turn count, first and last turn, and the last speaker of each session."""
    return turns.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.min("ordinal").alias("first_turn"), F.max("ordinal").alias("last_turn"), F.max_by("role", "ordinal").alias("last_role"))


def scoped(rows: DataFrame, **scope) -> DataFrame:
    """Rows within a scope of equal columns; a scope of None does not filter."""
    for name, value in scope.items():
        rows = rows if value is None else rows.where(F.col(name) == F.lit(value))
    return rows


def nested_detail(intervals: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their intervals and, in each, its turns, both in order, as text."""
    lines = turns.groupBy("session_id", "interval_ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "label"))), lambda x: x["label"]), "+").alias("turns"))
    rows = intervals.join(lines, ["session_id", "interval_ordinal"], "left")
    shown = F.concat(F.col("interval_ordinal").cast("string"), F.lit("="), F.coalesce("turns", F.lit("")))
    return rows.groupBy("session_id").agg(F.count("*").alias("n_intervals"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("interval_ordinal", shown.alias("s")))), lambda x: x["s"]), ";").alias("detail"))


def source_turns(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn that an edge starts from: by tool call, else by the parent turn's id, else the first turn."""
    by_call = turns.where("call_id IS NOT NULL").groupBy(F.col("session_id").alias("source"), "call_id").agg(F.min("ordinal").alias("a"))
    by_id = turns.select(F.col("session_id").alias("source"), F.col("turn_id").alias("parent_turn_id"), F.col("ordinal").alias("b"))
    first = turns.groupBy(F.col("session_id").alias("source")).agg(F.min("ordinal").alias("c"))
    rows = edges.join(by_call, ["source", "call_id"], "left").join(by_id, ["source", "parent_turn_id"], "left").join(first, "source", "left")
    return rows.withColumn("source_turn", F.coalesce("a", "b", "c")).drop("a", "b", "c")


def refresh_sessions(stored: DataFrame, fresh: DataFrame, values: list[str]) -> DataFrame:
    """Session rows with what a new normalisation gives; what it does not give stays."""
    new = fresh.select("session_id", *[F.col(v).alias(f"_{v}") for v in values])
    return stored.join(new, "session_id", "left").select("session_id", *[F.coalesce(f"_{v}", v).alias(v) for v in values])


# --- context documents ------------------------------------------------------------------------------------------
def context_documents(claims: DataFrame, entries: DataFrame, events: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Per workspace the sections of its context: profile, 8 live claims, 6 pinned entries, 5 recent events.

    Each part is ranked per workspace first; at most 20 short rows a workspace are gathered.
    """

    def section(rows: DataFrame, order: list[Column], most: int, line: Column, name: str) -> DataFrame:
        ranked = rows.withColumn("rk", F.row_number().over(Window.partitionBy("workspace_id").orderBy(*order))).where(F.col("rk") <= most)
        return ranked.groupBy("workspace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", line.alias("line")))), lambda x: x["line"]).alias(name))

    label = F.when(F.col("state").isin("supported", "contradicted", "decayed"), F.concat(F.lit("["), F.col("state"), F.lit("]"))).otherwise("[claim]")
    percent = F.concat(F.lit(" ("), F.round(F.col("confidence") * 100).cast("long").cast("string"), F.lit("%)"))
    a = section(claims.where("state NOT IN ('rejected', 'superseded')"), [F.col("confidence").desc(), "claim_text"], 8, F.concat(label, F.lit(" "), "claim_text", percent), "claims")
    b = section(entries.where("include_policy = 'always'"), [F.col("importance").desc(), "title"], 6, F.concat("title", F.lit(": "), "link"), "entries")
    c = section(events, [F.col("occurred_at").desc(), F.col("raw_event_id").desc()], 5, F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), "event_type", F.lit(" session="), "session_id"), "events")
    rows = workspaces.join(a, "workspace_id", "left").join(b, "workspace_id", "left").join(c, "workspace_id", "left")
    none = lambda col, words: F.coalesce(F.col(col), F.array(F.lit(words)))
    return rows.select(
        "workspace_id",
        F.array(F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.lit("No workspace profile summary yet."))).alias("profile"),
        none("claims", "No current claims projected yet.").alias("claims"),
        none("entries", "No Context Index entries pinned yet.").alias("entries"),
        none("events", "No recent raw events captured yet.").alias("events"),
    )


def markdown(documents: DataFrame, as_of: str) -> DataFrame:
    parts = [F.array(F.concat(F.lit("# Active Context for "), "workspace_id"), F.lit(""), F.lit(f"Generated: {as_of}"), F.lit(""))]
    for title, col in (("Workspace Profile", "profile"), ("Current Claims", "claims"), ("Context Index", "entries"), ("Recent Activity", "events")):
        parts.append(F.concat(F.array(F.lit(f"## {title}"), F.lit("")), F.transform(col, lambda x: F.concat(F.lit("- "), x)), F.array(F.lit(""))))
    return documents.select("workspace_id", F.rtrim(F.regexp_replace(F.array_join(F.concat(*parts), "\n"), r"\s+$", "")).alias("markdown"))


def context_links(entries: DataFrame, bindings: DataFrame) -> DataFrame:
    """Entries of enabled bindings with a link that carries their key, and the key read back from it."""
    link = F.concat(F.lit("context://"), F.url_encode("key"))
    rows = entries.join(bindings.where("enabled"), ["workspace_id", "source_type"], "left_semi")
    return rows.withColumn("link", link).withColumn("resolved_key", F.url_decode(F.substring_index("link", "context://", -1)))


# --- findings ---------------------------------------------------------------------------------------------------
CONTRACT = "narrative string, findings array<struct<key: string, type: string, text: string, evidence: array<struct<session: bigint, turn: int>>>>, dispositions array<struct<kind: string, fromKey: string, toKey: string, toFindingId: string>>"
#: Vocabularies of findings and dispositions.
FINDING_TYPES = ("decision", "learning", "question", "risk")
DISPOSITION_KINDS = ("builds_on", "refutes")


def finding_id(record: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", record, key), 256)


def load_findings(outputs: DataFrame) -> dict[str, DataFrame]:
    """Extractor outputs (record_id, body JSON) to records, findings, evidence, dispositions and violations."""
    parsed = outputs.withColumn("b", F.from_json("body", CONTRACT))
    rows = parsed.select("record_id", "b.narrative", F.posexplode("b.findings").alias("ordinal", "f"))
    rows = rows.select("record_id", "ordinal", F.col("f.key").alias("key"), F.col("f.type").alias("type"), F.col("f.text").alias("text"), F.col("f.evidence").alias("evidence"), finding_id(F.col("record_id"), F.col("f.key")).alias("finding_id"))
    repeated = rows.groupBy("record_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("record_id", F.lit("duplicate_key").alias("code"))
    wrong = rows.where(~F.col("type").isin(*FINDING_TYPES) | (F.trim("text") == "")).select("record_id", F.when(F.trim("text") == "", "empty_text").otherwise("bad_type").alias("code"))
    edges = parsed.select("record_id", F.explode("b.dispositions").alias("d")).select("record_id", "d.*")
    targets = rows.select("record_id", F.col("key").alias("toKey"), F.col("finding_id").alias("local_target")).dropDuplicates(["record_id", "toKey"])
    sources = rows.select("record_id", F.col("key").alias("fromKey"), F.col("finding_id").alias("source")).dropDuplicates(["record_id", "fromKey"])
    resolved = edges.join(sources, ["record_id", "fromKey"], "left").join(targets, ["record_id", "toKey"], "left")
    resolved = resolved.select("record_id", "kind", "source", F.coalesce("local_target", "toFindingId").alias("target"))
    known = rows.select(F.col("finding_id").alias("target")).distinct().withColumn("known", F.lit(True))
    checked = resolved.join(known, "target", "left")
    code = F.when(~F.col("kind").isin(*DISPOSITION_KINDS), "bad_kind").when(F.col("source").isNull(), "unknown_source").when(F.col("known").isNull(), "unknown_target").when(F.col("source") == F.col("target"), "self_edge")
    broken = parsed.where("b IS NULL OR b.narrative IS NULL").select("record_id", F.lit("bad_body").alias("code"))
    violations = repeated.unionByName(wrong).unionByName(broken).unionByName(checked.select("record_id", code.alias("code")).where("code IS NOT NULL"))
    good = lambda df: df.join(violations.select("record_id").distinct(), "record_id", "left_anti")
    return {
        "findings": good(rows.drop("evidence")),
        "evidence": good(rows.select("record_id", "finding_id", F.posexplode("evidence").alias("at", "e")).select("record_id", "finding_id", "at", "e.session", "e.turn")),
        "dispositions": good(checked.select("record_id", "kind", "source", "target")),
        "violations": violations,
    }


def record_details(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records with their findings and pointers nested in order, as text."""
    shown = evidence.groupBy("finding_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "session", "turn"))), lambda e: F.concat_ws("/", e["session"].cast("string"), e["turn"].cast("string"))), ";").alias("pointers"))
    rows = findings.join(shown, "finding_id", "left")
    line = F.concat_ws("|", "key", "type", F.coalesce("pointers", F.lit("")))
    return rows.groupBy("record_id").agg(F.count("*").alias("n_findings"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), ",").alias("findings"))


def delete_records(tables: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """All tables of findings without the given records."""
    ids = records.select("record_id").distinct()
    return {k: t.join(ids, "record_id", "left_anti") for k, t in tables.items()}


# --- safety -----------------------------------------------------------------------------------------------------
def erase(tables: dict[str, DataFrame], sessions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the given sessions, and the number of rows that go, by table and session."""
    ids = sessions.select("session_id").distinct()
    kept = {k: t.join(ids, "session_id", "left_anti") for k, t in tables.items()}
    gone = [t.join(ids, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(k)) for k, t in tables.items()]
    counts = gone[0]
    for g in gone[1:]:
        counts = counts.unionByName(g)
    return kept, counts.select("table", "session_id", "n")


def associated_events(events: DataFrame, sessions: DataFrame, listed: DataFrame) -> DataFrame:
    """(session_id, raw_event_id) by the event's own session or by lists of ids: equi-joins, then a union."""
    own = events.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "raw_event_id")
    named = listed.select("session_id", F.explode("raw_event_ids").alias("raw_event_id")).join(events.select("raw_event_id"), "raw_event_id", "left_semi").join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return own.unionByName(named.select("session_id", "raw_event_id")).distinct()


def hard_redaction(snapshots: DataFrame, patterns, body: str = "content") -> DataFrame:
    """Snapshots with a hit get a redacted successor that is active; all their older bodies are emptied."""
    text, hits = T.redact_patterns(F.col(body), patterns)
    rows = snapshots.withColumn("hits", hits).withColumn("redacted", text)
    touched = rows.groupBy("session_id").agg(F.sum("hits").alias("session_hits"), F.max("captured").alias("newest"))
    both = rows.join(touched, "session_id")
    last = both.where("session_hits > 0 AND captured = newest").select("session_id", (F.col("captured") + 1).alias("captured"), F.col("redacted").alias(body), F.lit("redacted").alias("status"), F.lit(True).alias("is_active"))
    old = both.select("session_id", "captured", F.when(F.col("session_hits") > 0, None).otherwise(F.col(body)).alias(body), F.when(F.col("session_hits") > 0, "emptied").otherwise("captured").alias("status"), ((F.col("captured") == F.col("newest")) & (F.col("session_hits") == 0)).alias("is_active"))
    return old.unionByName(last)


# --- embeddings -------------------------------------------------------------------------------------------------
def absent(segments: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("segment_id", "provider", "model", "dimensions")) -> DataFrame:
    """Segments with text but without an embedding of the provider, model and dimensions."""
    return segments.where(F.trim("text") != "").join(stored.select(*key), list(key), "left_anti")


def input_hash(dims: Column, model: Column, provider: Column, text: Column) -> Column:
    return F.sha2(F.to_json(F.struct(dims.alias("dimensions"), model.alias("model"), provider.alias("provider"), text.alias("text"))), 256)


def hashing_embedder(dims: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests and offline use: signed feature hashing of words, scaled to length 1."""
    import hashlib
    import math

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


#: Limits of one embedding request.
REQUEST_INPUTS, REQUEST_CHARS = 256, 400_000


def requests(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive requests within both limits; one text alone may exceed the characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and (len(part) == REQUEST_INPUTS or size + len(t) > REQUEST_CHARS):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def fill(missing: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dims: int) -> DataFrame:
    """segment_id, embedding and input hash of the missing segments, in requests; wrong vectors are dropped as failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [v for part in requests(batch.column(1).to_pylist()) for v in embedder(part)]
            ok = [v is not None and len(v) == dims and all(x == x and abs(x) != float("inf") for x in v) for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(vectors, pa.list_(pa.float32())), pa.array(ok)], ["segment_id", "input_hash", "embedding", "valid"])

    rows = missing.select(F.col("segment_id").cast("long"), "text", input_hash(F.col("dimensions"), F.col("model"), F.col("provider"), F.col("text")).alias("input_hash"))
    return rows.mapInArrow(run, "segment_id long, input_hash string, embedding array<float>, valid boolean")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with fresh ones in place of those of the same key."""
    return stored.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


# --- quality ----------------------------------------------------------------------------------------------------
def violations(table: DataFrame, name: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, key) for every row and rule that does not hold, in one pass."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())
    return table.select(F.lit(name).alias("table"), F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated_keys(table: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keys (null-safe) that occur more than once."""
    shown = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("∅")) for k in keys])
    return table.groupBy(shown.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("table"), F.lit("unique").alias("rule"), "key")


def orphans(child: DataFrame, parent: DataFrame, name: str, fk: str, pk: str, key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti").select(F.lit(name).alias("table"), F.lit("parent").alias("rule"), F.col(key).cast("string").alias("key"))
