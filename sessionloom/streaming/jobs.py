"""Structured Streaming forms: interval state machine, idempotent ledger, derivation in micro-batches.

All run on file sources with ``availableNow`` and may as well run with a processing-time trigger. Checkpoints and
sinks are in the shared folder that the session names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import bloom, claims, ledger
from ..operators.graph import shared_folder

IDLE = pd.Timedelta(minutes=30)
LABELLED = "session_id string, raw_event_id long, interval_ordinal long, opens boolean, settled string"
RUNS = "job string, run_id long, started_at timestamp, finished_at timestamp, status string, n_rows long, error string"
ERROR_CHARS = 2000
#: How long before its newest event a session's applied event ids are remembered.
REMEMBERED = pd.Timedelta(days=2)
STATE = "ordinal long, active boolean, last_us long, applied array<long>, applied_at array<long>"


def label_session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The interval rules for one session, event by event in order of arrival. An event that was applied before changes nothing."""
    ordinal, active, last, known, known_at = state.get if state.exists else (-1, False, 0, [], [])
    applied = dict(zip(known, known_at, strict=True))
    events = pd.concat(list(batches)).sort_values("arrival")
    rows = []
    for e in events.itertuples(index=False):
        if e.raw_event_id in applied:
            continue
        at, settled, opens = int(e.occurred_at.value // 1000), None, False
        stop = e.hook == "Stop"
        if not active:
            ordinal, opens, active = ordinal + 1, True, not stop
            settled = "stop_event" if stop else None
        elif e.hook == "SessionStart" and e.start_source in ("clear", "compact"):
            ordinal, opens, settled = ordinal + 1, True, "clear_context"
        elif at - last > IDLE.value // 1000:
            ordinal, opens, settled = ordinal + 1, True, "idle_timeout"  # a late stop leaves the new interval active
        elif stop:
            active, settled = False, "stop_event"
        last = at
        applied[e.raw_event_id] = at
        rows.append((key[0], e.raw_event_id, ordinal, opens, settled))
    newest = max(applied.values(), default=0)
    applied = {k: at for k, at in applied.items() if at >= newest - REMEMBERED.value // 1000}
    state.update((ordinal, active, last, list(applied), list(applied.values())))
    yield pd.DataFrame(rows, columns=["session_id", "raw_event_id", "interval_ordinal", "opens", "settled"])


def label_stream(events: DataFrame) -> DataFrame:
    """Streaming events (session_id, raw_event_id, hook, start_source, occurred_at) with their interval.

    ``arrival`` gives the order of arrival within a micro-batch, that of micro-batches comes first; without that column
    events arrive in the order of their times. Ids that were applied are kept for ``REMEMBERED`` before a session's newest event;
    a redelivery within that time gives no row and changes no state.
    """
    if "arrival" not in events.columns:
        events = events.withColumn("arrival", F.struct(F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("at"), "raw_event_id"))
    order = F.col("arrival") if events.schema["arrival"].dataType.typeName() != "struct" else F.format_string("%020d %020d", F.col("arrival.at") + (1 << 62), "arrival.raw_event_id")
    picked = events.select("session_id", "raw_event_id", "hook", "start_source", F.col("occurred_at").cast("timestamp").alias("occurred_at"), order.alias("arrival"))
    return picked.groupBy("session_id").applyInPandasWithState(label_session, LABELLED, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None] | None = None) -> DataFrame:
    """Run a stream over what is available and return its sink as a table."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if write is None:
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, number: write(df, number, f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def recorded(write: Callable[[DataFrame, int, str], None], job: str, runs: str) -> Callable[[DataFrame, int, str], None]:
    """``write`` that leaves a row of the run ledger for each micro-batch, also where it fails; the failure goes on.

    A batch that is tried again replaces its row, since each batch number has a folder of its own.
    """

    def run(df: DataFrame, number: int, path: str) -> None:
        spark, started = df.sparkSession, datetime.now(UTC)
        seen, status, error = Observation(), "failed", None
        try:
            write(df.observe(seen, F.count(F.lit(1)).alias("n")), number, path)
            status = "ok"
        except Exception as problem:
            error = str(problem)[:ERROR_CHARS]
            raise
        finally:
            n = seen.get["n"] if status == "ok" else None
            row = [(job, number, started, datetime.now(UTC), status, n, error)]
            spark.createDataFrame(row, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{runs}/batch={number}")

    return run


def run_with_ledger(stream: DataFrame, job: str, write: Callable[[DataFrame, int, str], None]) -> tuple[DataFrame, DataFrame]:
    """Run a stream over what is available; its sink and its run ledger. ``ledger.keep_newest`` is the retention."""
    runs = f"{shared_folder(stream.sparkSession)}/{job}-runs-{uuid.uuid4().hex}"
    out = run_to_table(stream, job, recorded(write, job, runs))
    return out, stream.sparkSession.read.schema(RUNS).parquet(f"{runs}/batch=*")


def append_batch(df: DataFrame, number: int, path: str) -> None:
    """Exactly-once append: first of each key in the batch, not there from earlier batches, into the batch's own folder.

    Beside its rows a batch leaves a Bloom filter of its keys (``operators/bloom.py``). A batch reads the earlier filters, and
    the rows of only those earlier batches that may hold one of its keys. A batch that is tried again replaces both.
    """
    spark, key = df.sparkSession, list(ledger.KEY)
    first = ledger.first_per_key(df, "arrival").withColumn("_key", F.xxhash64(*key))
    if number:
        filters = spark.read.schema(bloom.FILTER).parquet(*[f"{path}-filters/batch={n}" for n in range(number)])
        maybe = bloom.candidates(first.select("_key"), filters)
        batches = [r["owner"] for r in maybe.select("owner").distinct().collect()]  # numbers of batches, not rows
        if batches:
            earlier = spark.read.parquet(*[f"{path}/batch={n}" for n in batches])
            first = first.join(earlier.select(*key), key, "left_anti")
    first.drop("_key").write.mode("overwrite").parquet(f"{path}/batch={number}")
    written = spark.read.parquet(f"{path}/batch={number}").select(F.xxhash64(*key).alias("_key"))
    bloom.build(written, F.lit(number)).coalesce(1).write.mode("overwrite").parquet(f"{path}-filters/batch={number}")


#: Fixed by the state store: the value of a claim, and the keys of events that it has seen.
CLAIM = "event_type string, base double, occurred_us long, seq long, prior_events long, prior_against long, pinned boolean, watched boolean, last_review string, n_advances long, n_events long, n_against long, rank int"
CHANGED = "workspace_id string, claim_key long, version long, event_type string, base double, occurred_us long, latest_seq long, prior_events long, prior_against long, pinned boolean, watched boolean, last_review string, n_advances long"


class ClaimState(StatefulProcessor):
    """One claim's events in order of arrival: the fold of ``claims.project`` as a state that outlives micro-batches.

    A value state holds the claim (with the counts that its score needs), a map state the events already applied, so a
    redelivery in any later batch changes nothing. A claim that changed gives one row a batch, with a version that grows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claim = handle.getValueState("claim", CLAIM)
        self.seen = handle.getMapState("seen", "event_type string, raw_event_id long", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [f.split()[0] for f in CLAIM.split(", ")]
        held = self.claim.get() if self.claim.exists() else None
        now = dict(zip(names, held, strict=True)) if held else {"event_type": None, "n_events": 0, "n_against": 0, "n_advances": 0, "pinned": False, "watched": False}
        changed = False
        for e in pd.concat(list(rows)).sort_values(["arrival"]).to_dict("records"):
            mark = (e["event_type"], int(e["raw_event_id"]))
            if self.seen.containsKey(mark):
                continue
            self.seen.updateValue(mark, (int(e["seq"]),))
            kind, at, known = e["event_type"], int(e["occurred_us"]), now["event_type"] is not None
            state = claims.STATE_OF.get(kind)
            if state is None:
                if known and kind in claims.FLAGS:
                    name, value = claims.FLAGS[kind]
                    now |= {name: value, "last_review": kind}
                    changed = True
            else:
                rank = claims.PRECEDENCE.get(state, 0)
                if not known or (now["occurred_us"] <= at and (e["governed"] or rank >= now["rank"])):
                    now |= {"event_type": kind, "base": float(e["base"]), "occurred_us": at, "seq": int(e["seq"]), "rank": rank, "prior_events": now["n_events"], "prior_against": now["n_against"], "n_advances": now["n_advances"] + 1}
                    changed = True
            now["n_events"] += kind in claims.RECURRING
            now["n_against"] += kind == "contradicted"
        if now["event_type"] is not None or now["n_events"] or now["n_against"]:
            self.claim.update(tuple(now.get(n) for n in names))
        if changed:
            row = (key[0], key[1], now["n_advances"], *[now.get(n) for n in names[:10]])
            yield pd.DataFrame([row], columns=[f.split()[0] for f in CHANGED.split(", ")])

    def close(self) -> None:
        pass


def claim_stream(events: DataFrame) -> DataFrame:
    """Changes of claims from streaming events (workspace_id, claim_key, raw_event_id, seq, arrival, event_type, occurred_at, base, governed)."""
    picked = events.select("workspace_id", "claim_key", "raw_event_id", "seq", "arrival", "event_type", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("occurred_us"), "base", "governed")
    return picked.groupBy("workspace_id", "claim_key").transformWithStateInPandas(ClaimState(), CHANGED, "update", "none")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps several states of a key; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def newest_claims(changes: DataFrame) -> DataFrame:
    """The last version of each claim."""
    key = ["workspace_id", "claim_key"]
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("batch", "version")).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest if c != "batch"])


def write_changes(df: DataFrame, number: int, path: str) -> None:
    """Each micro-batch's changes in a folder of its own, so that a batch that is tried again replaces itself."""
    df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")
