"""Claims folded run by run against one loop over their events."""

import random

from pyspark.sql import functions as F

from sessionloom.operators import claims, folds

SCHEMA = "workspace_id string, claim_key long, seq long, event_type string, occurred_at timestamp_ntz, confidence double, governed boolean"
TYPES = [*claims.STATE_OF, *claims.FLAGS, "noted"]


def drawn(seed: int, keys: int, rows: int):
    """Events of which a third are one claim's; times rise, fall, or are drawn, with many ties."""
    from datetime import datetime, timedelta

    draw, out = random.Random(seed), []
    for seq in range(rows):
        key = draw.choice([0, draw.randrange(keys), draw.randrange(keys)])
        minute = {0: seq // 2, 1: rows - seq // 3}.get(key % 4, draw.randrange(40))
        out.append((draw.choice(["w", None]), key, seq, draw.choice(TYPES), datetime(2024, 1, 1) + timedelta(minutes=minute), seq / rows, draw.random() < 0.1))
    draw.shuffle(out)
    return out


def loop(rows):
    """The rule itself: one event after the other."""
    held = {}
    for ws, key, seq, kind, at, conf, governed in sorted(rows, key=lambda r: r[2]):
        state = claims.STATE_OF.get(kind)
        rank = claims.PRECEDENCE.get(state, 0)
        now = held.get((ws, key))
        if state is None:
            if now and kind in claims.FLAGS:
                name, value = claims.FLAGS[kind]
                now[name], now["review"] = value, kind
        elif now is None or (now["at"] <= at and (governed or rank >= now["rank"])):
            now = held.setdefault((ws, key), {"pinned": False, "watched": False, "review": None, "n": 0})
            now.update(state=state, rank=rank, at=at, conf=conf, seq=seq, n=now["n"] + 1)
    return sorted(((*k, v["state"], v["at"], v["conf"], v["seq"], v["pinned"], v["watched"], v["review"], v["n"]) for k, v in held.items()), key=repr)


def test_runs_of_any_length_equal_a_loop(spark):
    rows = drawn(3, 9, 1500)
    log = spark.createDataFrame(rows, SCHEMA)
    for bits in (0, 2, 5, 16):
        cut = folds.runs(log, bits)
        assert cut.groupBy("_run").count().agg(F.max("count")).first()[0] <= 2**bits
        got = sorted((tuple(r) for r in claims.project(cut).collect()), key=repr)
        assert got == loop(rows), bits


def test_states_before_in_small_blocks(spark):
    """Blocks of two runs: both levels are used, and every summary stays short whatever the order of times."""
    rows = [r for r in drawn(5, 5, 1200) if claims.STATE_OF.get(r[3])]
    log = folds.runs(spark.createDataFrame(rows, SCHEMA), 5)
    state = claims.state_of(F.col("event_type"))
    coded = log.withColumns({"state": state, "rank": claims._pick(state, claims.PRECEDENCE, 0), "micros": F.unix_micros(F.col("occurred_at").cast("timestamp"))})
    packed = coded.groupBy(*folds.KEY, "_run").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type", "state", "rank", "micros", "confidence", "governed"))).alias("log"))
    steps = packed.withColumn("steps", F.expr(folds.summary("log")))
    assert steps.agg(F.max(F.size("steps"))).first()[0] <= 30
    want = {}
    runs = {(r["workspace_id"], r["claim_key"], r["_run"]): {e["seq"] for e in r["log"]} for r in packed.collect()}
    for (ws, key, run), seqs in runs.items():
        earlier = loop([r for r in rows if r[0] == ws and r[1] == key and r[2] < min(seqs)])
        want[ws, key, run] = earlier[0][5] if earlier else None
    got = {(r["workspace_id"], r["claim_key"], r["_run"]): r["before"]["seq"] if r["before"] else None for r in folds.states_before(steps, 2).collect()}
    assert got == want


def test_counts_before_each_event(spark):
    rows = drawn(7, 4, 600)
    out = claims.prior_counts(folds.runs(spark.createDataFrame(rows, SCHEMA), 3)).collect()
    for r in out:
        earlier = [x[3] for x in rows if x[0] == r["workspace_id"] and x[1] == r["claim_key"] and x[2] < r["seq"]]
        assert (r["prior_events"], r["prior_against"]) == (sum(t in claims.RECURRING for t in earlier), earlier.count("contradicted"))


def test_no_events(spark):
    assert claims.project(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_claim_of_two_million_events(spark):
    """One claim holds all rows; no run is longer than 65 536 and the end is known."""
    log = spark.range(2_000_000).select(F.lit("w").alias("workspace_id"), F.lit(1).cast("long").alias("claim_key"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "supported").otherwise("extracted").alias("event_type"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("occurred_at"), F.lit(0.5).alias("confidence"))
    cut = folds.runs(log)
    assert cut.groupBy("_run").count().agg(F.max("count")).first()[0] <= 65_536
    (row,) = claims.project(cut).collect()
    assert (row["state"], row["latest_seq"], row["n_advances"]) == ("supported", 1_999_998, 1_000_000)
