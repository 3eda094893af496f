"""The derivation of records: attempts that fail half-way, records that fail, redelivery and vectors that come late."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import sessions
from sessionloom.streaming import derivation

RECORDS = "record_id long, content string"


def _job(spark, tmp_path, embedder=None, derive=derivation.chunks):
    return derivation.Derivation(spark, f"file://{tmp_path}/job", embedder or sessions.hashing_embedder(4), 4, derive).prepare()


def _records(spark, rows):
    return spark.createDataFrame([(i, t if t is None or t.startswith("!") else json.dumps({"text": t})) for i, t in rows], RECORDS)


def _counts(job):
    return {name: job.table(name).count() for name in ("segments", "status", "waiting", "embeddings")}


def _status(job):
    return {r.record_id: (r.status, r.attempts) for r in job.status().collect()}


def test_a_batch_that_fails_half_way_is_seen_once(spark, tmp_path):
    job = _job(spark, tmp_path)
    rows = _records(spark, [(1, "one two"), (2, ""), (3, "! no json"), (4, None), (1, "one two"), (None, "x")])

    def broken(texts):
        raise ValueError("no embedder today")

    job.embedder = broken
    with pytest.raises(Exception, match="no embedder today"):
        job.apply(rows, 0)
    # segments and status of the attempt are written, but no reader sees them
    assert spark.read.parquet(f"{job.base}/segments/batch=0").count() == 1
    assert _counts(job) == {"segments": 0, "status": 0, "waiting": 0, "embeddings": 0}
    job.embedder = sessions.hashing_embedder(4)
    job.apply(rows, 0)
    want = {"segments": 1, "status": 4, "waiting": 2, "embeddings": 1}
    assert _counts(job) == want
    job.apply(rows, 0)  # the same batch again
    assert _counts(job) == want
    assert _status(job) == {1: ("derived", 0), 2: ("derived", 0), 3: ("captured", 1), 4: ("captured", 1)}
    # records that come again in a later batch are known; those that wait are tried again
    job.apply(_records(spark, [(1, "another text"), (3, "good by now"), (5, "new")]), 1)
    assert _status(job) == {1: ("derived", 0), 2: ("derived", 0), 3: ("captured", 2), 4: ("captured", 2), 5: ("derived", 0)}
    assert sorted(r.text for r in job.table("segments").collect()) == ["new", "one two"]


def test_five_failures_are_the_end(spark, tmp_path):
    job = _job(spark, tmp_path)
    job.apply(_records(spark, [(7, "!" + "x" * 3000), (8, "fine")]), 0)
    assert job.settle() == 4
    (dead,) = job.status().where("status = 'failed'").collect()
    assert (dead.record_id, dead.attempts, len(dead.error)) == (7, 5, derivation.ERROR_CHARS)
    assert job.settle() == 0
    job.apply(_records(spark, [(7, "fine too")]), 1)
    assert _status(job)[7] == ("failed", 5)


def test_a_record_that_is_well_on_a_later_attempt(spark, tmp_path):
    job = _job(spark, tmp_path)
    job.apply(_records(spark, [(1, "! odd")]), 0)
    job.derive = lambda content: (F.array(content), F.lit(None).cast("string"))
    assert job.settle() == 1
    assert _status(job) == {1: ("derived", 1)} and [r.text for r in job.table("segments").collect()] == ["! odd"]


def test_vectors_that_are_not_valid_are_made_later(spark, tmp_path):
    job = _job(spark, tmp_path, lambda texts: [[1.0] if "two" in t else [1.0, 0.0, 0.0, 0.0] for t in texts])
    job.apply(_records(spark, [(1, "one"), (2, "two"), (3, "three")]), 0)
    assert [r.text for r in job.absent().collect()] == ["two"]
    job.embedder = sessions.hashing_embedder(4)
    assert job.settle() == 1 and job.absent().isEmpty()
    assert job.table("embeddings").where("valid").count() == 3


def test_stream_over_several_batches(spark, tmp_path):
    job = _job(spark, tmp_path)
    for i in range(3):
        _records(spark, [(i * 10 + k, f"text {i} {k}") for k in range(4)] + [(0, "text 0 0"), (100, "!")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job.run(spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    assert job.manifests().where("batch >= 0").count() == 3
    assert _status(job) == {i * 10 + k: ("derived", 0) for i in range(3) for k in range(4)} | {100: ("captured", 3)}
    assert job.table("segments").count() == job.table("embeddings").where("valid").count() == 12
