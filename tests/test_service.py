"""Look-ups and checks against literals; the run ledger over several micro-batches and a failing one."""

import pytest

from sessionloom.operators import ledger, service
from sessionloom.streaming import jobs


def test_identities(spark):
    ids = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("a", "9"), ("a", None), (None, "1")], "workspace_id string, id string")
    own = spark.createDataFrame([("a", 1)], "workspace_id string, session_id long")
    held = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 2)], "workspace_id string, session_id long, record_id long")
    got = sorted(map(tuple, service.identities(ids, own, held).collect()))
    assert got == [("a", "1", 1, None), ("a", "2", 6, 2)]
    assert service.identities(ids.limit(0), own, held).count() == 0


def test_evidence_codes(spark):
    events = spark.createDataFrame([(1, "a", "s", "x"), (2, None, "s", None)], "raw_event_id long, workspace_id string, source_id string, external_event_id string")
    rows = [(1, "a", "s", "x"), (1, "b", "s", "x"), (1, "a", "s", None), (2, None, "s", None), (3, "a", "s", "x"), (None, "a", "s", "x")]
    found = service.evidence_codes(spark.createDataFrame(rows, "raw_event_id long, workspace_id string, source_id string, external_event_id string"), events).collect()
    assert {tuple(r)[:4]: r.code for r in found} == dict(zip(rows, [None, "foreign_workspace", "source_mismatch", None, "missing_event", "missing_event"], strict=True))


def test_backfill_and_settlement_change_nothing_the_second_time(spark):
    records = spark.createDataFrame([(1, "captured"), (2, "failed"), (3, None)], "record_id long, status string")
    events = spark.createDataFrame([("a", i, hook) for i, hook in enumerate(["Stop", "SessionStart", "UserPromptSubmit", "Stop", "Stop"])], "workspace_id string, raw_event_id long, hook string")
    used = spark.createDataFrame([("a", 0)], "workspace_id string, raw_event_id long")
    queued = spark.createDataFrame([("a", 3, "failed")], "workspace_id string, raw_event_id long, status string")
    derived, queue = service.backfill(records, events, used, queued)
    assert sorted(map(tuple, derived.collect())) == [(1, "derived"), (2, "failed"), (3, None)]
    assert sorted(map(tuple, queue.collect())) == [("a", 1, "pending"), ("a", 3, "failed"), ("a", 4, "pending")]
    assert sorted(map(tuple, service.backfill(derived, events, used, queue)[1].collect())) == sorted(map(tuple, queue.collect()))
    applied = spark.createDataFrame([(1,), (1,), (3,)], "raw_event_id long")
    once = service.settle(queue, applied)
    assert sorted((r.raw_event_id, r.status) for r in once.collect()) == [(1, "settled"), (3, "failed"), (4, "pending")]
    assert sorted(map(tuple, service.settle(once, applied).collect())) == sorted(map(tuple, once.collect()))


def test_run_ledger(spark, tmp_path):
    for i, n in enumerate((3, 5, 2)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out, runs = jobs.run_with_ledger(stream, "copy", lambda df, number, path: df.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    rows = runs.orderBy("run_id").collect()
    assert out.count() == 10 and [r.status for r in rows] == ["ok"] * 3 and sorted(r.n_rows for r in rows) == [2, 3, 5]
    kept = ledger.keep_newest(runs, 2)
    assert sorted(r.run_id for r in kept.collect()) == [1, 2]

    def fail(df, number, path):
        raise ValueError("no room " * 1000)

    runs = f"{tmp_path}/runs"
    with pytest.raises(ValueError):
        jobs.recorded(fail, "broken", runs)(spark.range(3), 0, f"{tmp_path}/out")
    (row,) = spark.read.schema(jobs.RUNS).parquet(f"{runs}/batch=*").collect()
    assert (row.job, row.status, row.n_rows, len(row.error)) == ("broken", "failed", None, jobs.ERROR_CHARS)
