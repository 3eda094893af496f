"""Operators on small literals: intervals, claims, lineage, findings, idempotence, batch against stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import claims, graph, intervals, ledger, recall, sessions, snapshots, transcripts
from sessionloom.streaming import jobs

AT = dt.datetime(2024, 1, 1, 12)


def events(spark, *rows):
    data = [("s", i, hook, start, AT + dt.timedelta(minutes=m)) for i, (m, hook, start) in enumerate(rows)]
    return spark.createDataFrame(data, "session_id string, raw_event_id long, hook string, start_source string, occurred_at timestamp_ntz")


def spans(df):
    return [(r["interval_ordinal"], r["status"], r["reason"], r["ended_at"]) for r in df.orderBy("interval_ordinal").collect()]


def test_clear_opens_a_new_interval(spark):
    got = spans(intervals.intervals(events(spark, (0, "UserPromptSubmit", None), (2, "SessionStart", "clear")), ["raw_event_id"]))
    assert got == [(0, "settled", "clear_context", AT + dt.timedelta(minutes=2)), (1, "active", None, None)]


def test_idle_ends_half_an_hour_after_the_last_event(spark):
    got = spans(intervals.intervals(events(spark, (0, "UserPromptSubmit", None), (45, "UserPromptSubmit", None)), ["raw_event_id"]))
    assert got == [(0, "settled", "idle_timeout", AT + dt.timedelta(minutes=30)), (1, "active", None, None)]


def test_late_stop_leaves_the_new_interval_active(spark):
    got = spans(intervals.intervals(events(spark, (0, "UserPromptSubmit", None), (45, "Stop", None)), ["raw_event_id"]))
    assert [x[1] for x in got] == ["settled", "active"]
    assert spans(intervals.intervals(events(spark, (0, "UserPromptSubmit", None), (5, "Stop", None)), ["raw_event_id"]))[0][2] == "stop_event"


def score(spark, **given):
    base = dict(kind="decision", trusted=False, own_source="own")
    cols = {k: (v if k == "own_source" else F.lit(v)) for k, v in (base | given).items()}
    return spark.range(1).select(claims.confidence(**{k: (F.lit(v) if k == "own_source" else v) for k, v in cols.items()}).alias("x")).first()["x"]


def test_confidence_goldens(spark):
    assert score(spark, base=0.72, event_type="supported", actor="control-plane", source="own", trusted=True, age_days=0, prior_events=2, prior_against=0) == 1.0
    assert score(spark, base=0.72, event_type="contradicted", actor="codex", source="codex", age_days=200, prior_events=3, prior_against=2) == 0.4


def test_claim_fold_is_in_order_of_arrival(spark):
    rows = [("w", 1, 1, "extracted", AT, 0.5), ("w", 1, 2, "rejected", AT + dt.timedelta(days=2), 0.1), ("w", 1, 3, "supported", AT + dt.timedelta(days=3), 0.9), ("w", 1, 4, "pinned", AT, 0.9), ("w", 2, 5, "pinned", AT, 0.9)]
    out = claims.project(spark.createDataFrame(rows, "workspace_id string, claim_key long, seq long, event_type string, occurred_at timestamp_ntz, confidence double")).collect()
    assert [(r["claim_key"], r["state"], r["pinned"], r["latest_seq"]) for r in out] == [(1, "rejected", True, 2)]


def test_decisions_go_back_and_attributes_outlive_advances(spark):
    day = lambda n: AT + dt.timedelta(days=n)
    rows = [
        ("w", 1, 1, "watched", day(0), "x"),  # no claim yet: nothing to mark
        ("w", 1, 2, "extracted", day(1), "x"), ("w", 1, 3, "pinned", day(0), "x"), ("w", 1, 4, "rejected", day(2), "claim.review"),
        ("w", 1, 5, "promoted", day(3), "x"), ("w", 1, 6, "promoted", day(1), "claim.promotion"),  # of lower precedence; older
        ("w", 1, 7, "promoted", day(2), "claim.promotion"), ("w", 1, 8, "watched", day(2), "x"), ("w", 1, 9, "strange", day(9), "x"),
        ("w", 2, 10, "extracted", day(1), "x"), ("w", 2, 11, "pinned", day(1), "x"), ("w", 2, 12, "unpinned", day(1), "x"), ("w", 2, 13, "rejected", day(2), None), ("w", 2, 14, "decayed", day(3), None),
    ]
    log = spark.createDataFrame(rows, "workspace_id string, claim_key long, seq long, event_type string, occurred_at timestamp_ntz, evidence_type string").withColumn("confidence", F.lit(0.5))
    out = claims.project(log.withColumn("governed", claims.governed(F.col("event_type"), F.col("evidence_type")))).orderBy("claim_key").collect()
    assert [(r["state"], r["latest_seq"], r["pinned"], r["watched"], r["last_review"], r["n_advances"]) for r in out] == [("supported", 7, True, True, "watched", 3), ("rejected", 13, False, False, "unpinned", 2)]


def test_links_carry_long_keys_whole(spark):
    key = "näme/ " * 400
    entries = spark.createDataFrame([("w", "t", key)], "workspace_id string, source_type string, key string")
    bindings = spark.createDataFrame([("w", "t", True)], "workspace_id string, source_type string, enabled boolean")
    assert sessions.context_links(entries, bindings).first()["resolved_key"] == key


def test_lineage_that_does_not_settle_is_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.lineage(spark.createDataFrame([(i, i + 1) for i in range(40)], "source long, target long"), depth=1)


def test_ledger_append_is_idempotent(spark):
    rows = spark.createDataFrame([("w", "s", "i", "e1", 1), ("w", "s", "i", "e1", 2), ("v", "s", "i", "e1", 3)], "workspace_id string, source_type string, source_id string, external_event_id string, arrival long")
    first = ledger.append(rows.limit(0), rows, "arrival")
    assert sorted(r["arrival"] for r in first.collect()) == [1, 3]
    assert ledger.append(first, rows, "arrival").count() == 0


def test_external_id_of_a_hook(spark):
    hook = F.struct(F.lit("/repo").alias("cwd"), F.lit("UserPromptSubmit").alias("hook_event_name"), F.lit("m").alias("model"), F.lit("s").alias("session_id"), F.lit("t").alias("turn_id"), F.lit("/tmp/t.jsonl").alias("transcript_path"))
    out = ledger.envelope(spark.range(1).select(hook.alias("hook")), "codex", ["cwd", "hook_event_name", "model", "session_id", "turn_id", "transcript_path"]).first()
    assert out["external_event_id"].startswith("codex:UserPromptSubmit:s:t:/tmp/t.jsonl:") and out["event_type"] == "codex.UserPromptSubmit"


def test_snapshots_dedupe_and_activate(spark):
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a")], "session_id string, captured long, content string")
    got = [(r["captured"], r["snapshot_ordinal"], r["is_active"]) for r in snapshots.history(rows).orderBy("captured").collect()]
    assert got == [(1, 0, False), (2, 1, True)]


def test_lineage_joins_chains_and_ignores_direction(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (8, 9)], "source long, target long")
    assert dict(graph.lineage(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert graph.lineage(edges.limit(0)).count() == 0


def test_findings_with_a_repeated_key_are_refused(spark):
    good = '{"narrative":"n","findings":[{"key":"a","type":"decision","text":"t","evidence":[{"session":1,"turn":2}]}],"dispositions":[]}'
    twice = '{"narrative":"n","findings":[{"key":"a","type":"decision","text":"t","evidence":[]},{"key":"a","type":"decision","text":"t","evidence":[]}],"dispositions":[{"kind":"builds_on","fromKey":"a","toKey":"zz"}]}'
    out = sessions.load_findings(spark.createDataFrame([("1", good), ("2", twice), ("3", "{")], "record_id string, body string"))
    assert [r["record_id"] for r in out["findings"].collect()] == ["1"]
    assert {(r["record_id"], r["code"]) for r in out["violations"].collect()} >= {("2", "duplicate_key"), ("2", "unknown_target"), ("3", "bad_body")}


def test_embedding_requests_and_fill(spark):
    assert [len(x) for x in sessions.requests(["a"] * 600)] == [256, 256, 88]
    assert [len(x) for x in sessions.requests(["a" * 300_000, "b" * 200_000])] == [1, 1]
    missing = spark.createDataFrame([(1, "some words", "p", "m", 8)], "segment_id long, text string, provider string, model string, dimensions int")
    row = sessions.fill(missing, sessions.hashing_embedder(8), 8).first()
    assert row["valid"] and len(row["embedding"]) == 8


def test_knn_excludes_itself_and_bad_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"]) for r in recall.knn(rows, rows.where("vec_id = 0"), 2, 2).orderBy("rank").collect()]
    assert got == [(0, 1), (0, 2)]


def test_tool_pairs_need_one_call_before_one_result(spark):
    rows = [("s", 0, "tool_call", "a"), ("s", 1, "tool_result", "a"), ("s", 2, "text", None), ("s", 3, "tool_result", "b"), ("s", 4, "tool_call", "b"), ("s", 5, "text", None), ("s", 6, "tool_call", "c"), ("s", 7, "tool_call", "c"), ("s", 8, "tool_result", "c")]
    runs = sessions.tool_runs(spark.createDataFrame(rows, "session_id string, ordinal long, part_type string, call_id string"))
    assert [(r["call_id"], r["call_at"], r["result_at"]) for r in sessions.tool_pairs(runs).collect()] == [("a", 0, 1)]


def test_hard_redaction_leaves_no_trace(spark):
    rows = spark.createDataFrame([("s", 1, "my super-secret-token"), ("s", 2, "clean"), ("t", 3, "clean")], "session_id string, captured long, content string")
    out = sessions.hard_redaction(rows, [("super-secret-token", "[x]", True)]).collect()
    assert not any("super-secret" in (r["content"] or "") for r in out)
    assert [(r["captured"], r["status"]) for r in out if r["is_active"]] == [(3, "captured"), (3, "redacted")] or {(r["session_id"], r["status"]) for r in out if r["is_active"]} == {("s", "redacted"), ("t", "captured")}


def test_contents_that_are_plain_strings_are_turns(spark):
    body = '{"type":"user","message":{"role":"user","content":"[not a list] hé"}}\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"yes"},{"type":"tool_use","id":"c","name":"grep","input":{"a":1}}]}}\n{"type":"x"}'
    turns, life = transcripts.turns_a(transcripts.scan_lines(spark.createDataFrame([("r", body)], "record_id string, body string")))
    assert [(r["role"], r["kind"], r["text"]) for r in turns.orderBy("line", "part").collect()] == [("user", "text", "[not a list] hé"), ("assistant", "text", "yes"), ("assistant", "tool_call", '{"a":1}')]
    assert [r["type"] for r in life.collect()] == ["x"]


def test_whole_documents_are_scanned(spark):
    rows = [("a", '[{"type":"user"}, 3, {"x":"é"}]'), ("b", '{"type":"user"}'), ("c", "{"), ("d", "[]"), ("e", "3"), ("f", None)]
    got = transcripts.scan_documents(spark.createDataFrame(rows, "record_id string, body string")).orderBy("record_id", "line").collect()
    assert [(r["record_id"], r["line"], r["parsed"]) for r in got] == [("a", 0, True), ("a", 2, True), ("b", 0, True), ("c", 0, False), ("f", 0, False)]
    assert (got[0]["char_end"], got[0]["byte_end"]) == (31, 32)


def test_streams_agree_with_batches_over_several_micro_batches(spark, tmp_path):
    hooks = ["SessionStart", "UserPromptSubmit", "Stop", "UserPromptSubmit", "UserPromptSubmit", "SessionStart"]
    starts = [None, None, None, None, None, "clear"]
    rows = [(f"s{i % 3}", i, hooks[(i // 3) % 6], starts[(i // 3) % 6], AT + dt.timedelta(minutes=7 * i if i < 30 else 60 * i)) for i in range(60)]
    log = spark.createDataFrame(rows, "session_id string, raw_event_id long, hook string, start_source string, occurred_at timestamp_ntz")
    for part in range(4):  # a file is a micro-batch; every third event is sent again with the next one
        again = log.where(f"raw_event_id BETWEEN {15 * part - 15} AND {15 * part - 1} AND raw_event_id % 3 = 0")
        sent = log.where(f"raw_event_id BETWEEN {15 * part} AND {15 * part + 14}").withColumn("arrival", F.col("raw_event_id") * 2)
        sent.coalesce(1).write.mode("append").parquet(f"{tmp_path}/once")
        sent.unionByName(again.withColumn("arrival", F.col("raw_event_id") * 2 + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/twice")
    stream = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    sent = spark.read.parquet(f"{tmp_path}/once")
    got = jobs.run_to_table(jobs.label_stream(stream("once", sent)), "several").select("session_id", "raw_event_id", "interval_ordinal", "opens")
    want = intervals.labelled(log, ["occurred_at", "raw_event_id"]).select("session_id", "raw_event_id", "interval_ordinal", "opens")
    assert sorted(got.collect()) == sorted(want.collect())
    keyed = stream("twice", sent).select(F.lit("w").alias("workspace_id"), F.lit("t").alias("source_type"), F.lit("i").alias("source_id"), F.col("raw_event_id").cast("string").alias("external_event_id"), "arrival")
    assert sorted(r["arrival"] for r in jobs.run_to_table(keyed, "ledger", jobs.append_batch).collect()) == [2 * i for i in range(60)]
