"""Event ledger: hook envelopes, idempotent append, acknowledgements, queues and event summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("workspace_id", "source_type", "source_id", "external_event_id")
BOUNDARY = ("Stop", "SessionStart")


def canonical_json(record: str, names: list[str]) -> Column:
    """Compact JSON of a struct's fields with keys in order; null fields are left out."""
    return F.to_json(F.struct(*[F.col(f"{record}.{n}").alias(n) for n in sorted(names)]))


def envelope(hooks: DataFrame, source: str, names: list[str]) -> DataFrame:
    """Hook records (struct column ``hook``) to ledger envelopes with a deterministic external id."""
    name = F.coalesce(F.nullif(F.trim("hook.hook_event_name"), F.lit("")), F.lit("unknown"))
    parts = [F.lit(source), name, *[F.coalesce(F.col(f"hook.{k}"), F.lit("")) for k in ("session_id", "turn_id", "transcript_path")], F.sha2(canonical_json("hook", names), 256)]
    provenance = F.struct(F.col("hook.cwd").alias("cwd"), name.alias("hookEventName"), F.col("hook.model").alias("model"))
    return hooks.select(
        "*",
        F.concat(F.lit(f"{source}."), name).alias("event_type"),
        F.lit(f"{source}:local").alias("source_id"),
        F.lit("raw").alias("trust_level"),
        F.concat_ws(":", *parts).alias("external_event_id"),
        provenance.alias("provenance"),
    )


def occurrence_keys(events: DataFrame, lines: DataFrame) -> DataFrame:
    """``events`` (session_id, prompt) with ``occurrence_key``: transcript-N for N user lines of the session with that text."""
    counts = lines.where("role = 'user'").groupBy("session_id", F.col("text").alias("prompt")).agg(F.count("*").alias("n"))
    found = events.join(counts, ["session_id", "prompt"], "left")
    return found.withColumn("occurrence_key", F.when(F.col("n") > 0, F.concat(F.lit("transcript-"), F.col("n").cast("string"))).otherwise("")).drop("n")


def first_per_key(events: DataFrame, order: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """The first arrival of each ledger key; a combined aggregate, so a key with many redeliveries is one row a task."""
    names = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min(F.struct(order, *[c for c in names if c != order])).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in names])


def append(ledger: DataFrame, incoming: DataFrame, order: str, bindings: DataFrame | None = None) -> DataFrame:
    """What an append adds: bound, first of its key, and not there yet."""
    if bindings is not None:
        incoming = incoming.join(bindings, ["workspace_id", "source_type"], "left_semi")
    return first_per_key(incoming, order).join(ledger.select(*KEY), list(KEY), "left_anti")


def ingest_acks(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """One acknowledgement per item: error with a code, duplicate (stored before or earlier in the batch) or stored."""
    code = F.when(F.col("external_event_id").isNull(), "missing_id").when(F.coalesce(F.col("payload").isNull() | F.try_parse_json("payload").isNull(), F.lit(True)), "bad_payload").when(F.col("value") < 0, "bad_value")
    coded = items.withColumn("code", code)
    first = coded.where("code IS NULL").groupBy(*KEY).agg(F.min("item").alias("first_item"))
    there = ledger.select(*KEY).distinct().withColumn("known", F.lit(True))
    found = coded.join(first, list(KEY), "left").join(there, list(KEY), "left")
    status = F.when(F.col("code").isNotNull(), "error").when(F.coalesce("known", F.lit(False)) | (F.col("item") != F.col("first_item")), "duplicate").otherwise("stored")
    return found.select("item", "external_event_id", status.alias("status"), "code")


def settlement_queue(events: DataFrame, queued: DataFrame) -> DataFrame:
    """Boundary events that are not queued yet, once each."""
    return events.where(F.col("hook").isin(*BOUNDARY)).select("workspace_id", "raw_event_id", "session_id", "occurred_at").join(queued, "raw_event_id", "left_anti")


def fifo(queue: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The oldest pending entries with their place; the limit is the batch size of a worker."""
    batch = queue.orderBy(*order).limit(limit)
    return batch.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def recent(rows: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group with their rank; only ranks up to the limit leave a task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def activation(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Per workspace: active, stale or without evidence, and start sources that were never seen."""
    horizon = F.lit(as_of).cast("timestamp_ntz")
    real = F.col("hook").isin("SessionStart", "UserPromptSubmit")
    seen = events.groupBy("workspace_id").agg(
        F.max(F.when(real, F.col("occurred_at"))).alias("last_seen"),
        F.count_if(real).alias("n_real"),
        F.array_sort(F.collect_set("start_source")).alias("observed"),
    )
    every = F.array(F.lit("clear"), F.lit("compact"), F.lit("resume"), F.lit("startup"))
    state = F.when(F.col("last_seen").isNull(), "no_evidence").when(F.col("last_seen") >= horizon - F.expr(f"INTERVAL {hours} HOURS"), "active").otherwise("stale")
    return seen.select("workspace_id", state.alias("state"), "n_real", F.array_join("observed", ",").alias("observed"), F.array_join(F.array_except(every, "observed"), ",").alias("unproven"))


def keep_newest(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Retention: the newest runs of each job."""
    return recent(runs, "job", [F.col("finished_at").desc(), F.col("run_id").desc()], limit)


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each job, by a combined aggregate."""
    return runs.groupBy("job").agg(F.max(F.struct("finished_at", "run_id", "status")).alias("r")).select("job", F.col("r.run_id").alias("run_id"), F.col("r.status").alias("status"), F.col("r.finished_at").alias("finished_at"))


def dead_letters(attempts: DataFrame, most: int = 5, chars: int = 2000) -> DataFrame:
    """Queue state after failures: pending until ``most`` attempts failed, then failed, with the last error."""
    state = attempts.groupBy("raw_event_id").agg(F.count("*").alias("attempts"), F.max_by(F.substring("error", 1, chars), "at").alias("last_error"))
    return state.withColumn("status", F.when(F.col("attempts") >= most, "failed").otherwise("pending"))


def canonical_users(users: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each row's canonical row: the first of its key (null-safe), and whether it is that row."""
    w = Window.partitionBy(*key).orderBy(*order)
    return users.withColumn("canonical_id", F.first(order[-1]).over(w)).withColumn("is_canonical", F.col("canonical_id") == F.col(order[-1]))


def merge_dimension(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Upsert of a dimension: new values win where they are given."""
    renamed = new.select(F.col(key), *[F.col(v).alias(f"_new_{v}") for v in values])
    return old.join(renamed, key, "full_outer").select(key, *[F.coalesce(f"_new_{v}", v).alias(v) for v in values])
