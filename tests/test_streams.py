"""Streams over several micro-batches: redelivery, late events, pruned look-ups."""

import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from sessionloom.operators import bloom, claims, intervals
from sessionloom.streaming import jobs

AT = dt.datetime(2024, 1, 1)


def in_batches(spark, df, path, size):
    """A stream that reads ``size`` arrivals a micro-batch."""
    last = df.agg(F.max("arrival")).first()[0]
    for start in range(0, last + 1, size):
        df.where(f"arrival >= {start} AND arrival < {start + size}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def hooks(spark, rows):
    schema = "session_id string, raw_event_id long, hook string, start_source string, occurred_at timestamp_ntz, arrival long"
    return spark.createDataFrame(rows, schema)


def test_a_trigger_that_comes_again_changes_nothing(spark, tmp_path):
    clear = ("SessionStart", "clear")
    sent = [(1, "UserPromptSubmit", None), (2, *clear), (2, *clear), (3, "UserPromptSubmit", None), (2, *clear), (1, "UserPromptSubmit", None)]
    log = hooks(spark, [("s", i, h, c, AT + dt.timedelta(minutes=i), k) for k, (i, h, c) in enumerate(sent)])
    want = [("s", 1, 0, True), ("s", 2, 1, True), ("s", 3, 1, False)]
    batch = intervals.labelled(intervals.first_deliveries(log), ["arrival"]).select("session_id", "raw_event_id", "interval_ordinal", "opens")
    assert sorted(map(tuple, batch.collect())) == want
    for size in (1, 3):
        stream = jobs.run_to_table(jobs.label_stream(in_batches(spark, log, f"{tmp_path}/{size}", size)), "again")
        assert sorted(map(tuple, stream.select("session_id", "raw_event_id", "interval_ordinal", "opens").collect())) == want


def test_late_events_are_taken_as_they_arrive(spark, tmp_path):
    draw = random.Random(2)
    rows = []
    for k in range(240):
        late = draw.choice([0, 0, 0, 90])
        hook, source = draw.choice([("Stop", None), ("SessionStart", "clear"), ("SessionStart", "resume"), ("UserPromptSubmit", None)])
        rows.append((f"s{k % 5}", k if draw.random() < 0.85 or k < 10 else k - draw.choice([5, 10]), hook, source, AT + dt.timedelta(minutes=9 * k - late), k))
    log = hooks(spark, rows)
    want = intervals.labelled(intervals.first_deliveries(log), ["arrival"]).select("session_id", "raw_event_id", "interval_ordinal", "opens")
    got = jobs.run_to_table(jobs.label_stream(in_batches(spark, log, str(tmp_path), 50)), "late").select("session_id", "raw_event_id", "interval_ordinal", "opens")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_claims_from_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """Redelivered events in later micro-batches, and events older than the claim's state."""
    draw = random.Random(3)
    kinds = [*claims.STATE_OF, *claims.FLAGS, "noted"]
    first = [("w", k % 7, k, k, draw.choice(kinds), AT + dt.timedelta(hours=draw.randint(0, 60)), draw.random(), draw.random() < 0.2) for k in range(300)]
    sent = [(*r, 2 * r[3]) for r in first] + [(*r, 2 * r[3] + 2 * draw.randint(1, 90) + 1) for r in first if draw.random() < 0.4]
    names = "workspace_id string, claim_key long, raw_event_id long, seq long, event_type string, occurred_at timestamp_ntz, base double, governed boolean"
    log = spark.createDataFrame(sent, f"{names}, arrival long")
    with jobs.state_store(spark):
        changes = jobs.run_to_table(jobs.claim_stream(in_batches(spark, log, str(tmp_path), 150)), "claims", jobs.write_changes)
    assert changes.select("batch").distinct().count() > 3
    got = jobs.newest_claims(changes.drop("part"))
    got = got.select("workspace_id", "claim_key", claims.state_of(F.col("event_type")).alias("state"), "latest_seq", "pinned", "watched", "last_review", "n_advances", "prior_events", "prior_against")
    once = spark.createDataFrame(first, names)
    scored = claims.prior_counts(once)
    want = claims.project(scored.withColumn("confidence", F.lit(0.5))).select("workspace_id", "claim_key", "state", "latest_seq", "pinned", "watched", "last_review", "n_advances")
    want = want.join(scored.select("workspace_id", "claim_key", F.col("seq").alias("latest_seq"), "prior_events", "prior_against"), ["workspace_id", "claim_key", "latest_seq"]).select(got.columns)
    assert got.count() == 7 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_append_reads_only_batches_that_may_hold_its_keys(spark, tmp_path):
    path, batches = f"{tmp_path}/ledger", 12
    rows = lambda ids, first: spark.createDataFrame([("w", "t", "i", str(k), first + n) for n, k in enumerate(ids)], "workspace_id string, source_type string, source_id string, external_event_id string, arrival long")
    for n in range(batches):
        again = [] if n < 6 else [(n - 2) * 100 + k for k in range(20)]  # each later batch sends some of one earlier batch again
        jobs.append_batch(rows([*range(n * 100, n * 100 + 100), *again], n * 1000), n, path)
    whole = spark.read.parquet(*[f"{path}/batch={n}" for n in range(batches)])
    assert whole.count() == whole.select("external_event_id").distinct().count() == 100 * batches
    # rows that a new batch may meet: those of one earlier batch, however many there are
    filters = spark.read.schema(bloom.FILTER).parquet(*[f"{path}-filters/batch={n}" for n in range(batches)])
    asked = rows([*range(300, 320), *range(9000, 9100)], 0).select(F.xxhash64("workspace_id", "source_type", "source_id", "external_event_id").alias("_key"))
    assert {r["owner"] for r in bloom.candidates(asked, filters).collect()} == {3}
    for n in range(batches):
        if n != 3:
            shutil.rmtree(f"{path}/batch={n}")
    jobs.append_batch(rows([*range(300, 320), *range(9000, 9100)], 99_000), batches, path)
    assert spark.read.parquet(f"{path}/batch={batches}").count() == 100


def test_bloom_filters_lose_no_key_and_merge(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("_key"))
    filters = bloom.build(keys, F.pmod("_key", F.lit(3)))
    met = bloom.candidates(keys, filters).join(keys.select("_key", F.pmod("_key", F.lit(3)).cast("int").alias("owner")), ["_key", "owner"])
    assert met.count() == 20_000
    others = spark.range(20_000).select(F.xxhash64("id", F.lit("x")).alias("_key"))
    assert bloom.candidates(others, filters).count() < 20
    assert bloom.candidates(keys, bloom.merge(filters, F.lit(9))).where("owner = 9").count() == 20_000
    assert bloom.candidates(keys, filters.limit(0)).count() == 0
