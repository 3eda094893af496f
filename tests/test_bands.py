"""Band joins against all pairs, and a very long session."""

import random

from pyspark.sql import functions as F

from sessionloom.operators import bands, recall


def test_band_join_equals_all_pairs(spark):
    draw = random.Random(4)
    anchors = [(draw.choice("ab"), draw.choice([draw.randint(-40, 40), None])) for _ in range(60)]
    rows = [(draw.choice(["a", "b", None]), draw.randint(-45, 45), k) for k in range(200)]
    left, right = spark.createDataFrame(anchors, "s string, anchor long"), spark.createDataFrame(rows, "s string, at long, k long")
    for before, after in ((0, 0), (2, 5), (20, 0), (1, 1)):
        got = sorted((r["s"], r["anchor"], r["k"]) for r in bands.band_join(left, right, "s", "at", "anchor", before, after).collect())
        want = sorted((s, a, k) for s, a in anchors for t, at, k in rows if s == t and a is not None and a - before <= at <= a + after)
        assert got == want


def test_a_session_of_a_million_turns_is_linear(spark):
    """300 000 anchors in one session of a million turns: all pairs would be 3e11."""
    turns = spark.range(1_000_000).select(F.lit("s").alias("session_id"), F.col("id").alias("ordinal"))
    assert recall.context(turns.where("ordinal < 300000"), turns, 2, 2).count() == 300_000 * 5 - 3


def test_expansion_has_segments_and_warnings(spark):
    turns = spark.createDataFrame([("s", 0, "redacted", False), ("s", 1, "captured", True), ("s", 2, "redacted", True), ("s", 9, "captured", False), ("t", 1, "captured", False)], "session_id string, ordinal long, record_status string, skipped boolean")
    segments = spark.createDataFrame([("s", 1, 12), ("s", 1, 11), ("t", 1, 13)], "session_id string, ordinal long, segment_id long")
    out = bands.expand_context(spark.createDataFrame([("s", 1)], "session_id string, ordinal long"), turns, segments, -3, 99)
    got = {r["ordinal"]: (r["distance"], r["segment_ids"], r["warnings"]) for r in out.collect()}
    assert got == {1: (0, [11, 12], ["payload_skipped"]), 2: (1, [], ["record_redacted", "payload_skipped"]), 9: (8, [], [])}
