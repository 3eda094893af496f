"""Order-dependent folds over keys of any length: runs of sorted rows, and summaries of runs that can be composed.

The state of a claim moves to an event when the event is no older and of no lower precedence, or governed. What a run of
events does to every possible state before it is a short list of steps (``rank``, ``hi``, ``to``): a state of that rank
whose time is at most ``hi``, and above the next lower step's, ends in ``to``; a state beyond all steps of its rank
stays. A claim without a state has rank -1. Steps of two runs compose to the steps of both, so the states before all runs
come from the summaries alone, and every run is then folded by itself from the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

KEY = ("workspace_id", "claim_key")
#: Rows of a run are at most 2 to this power.
RUN_BITS = 16
#: Summaries that are composed to the summary of a block.
BLOCK = 256
#: Ranks of states, with -1 for none.
RANKS = "sequence(-1, 4)"
FOREVER = "9223372036854775807L"

PLACE = "STRUCT<micros: BIGINT, rank: INT, seq: BIGINT, state: STRING, confidence: DOUBLE>"
STEPS = f"ARRAY<STRUCT<rank: INT, hi: BIGINT, to: {PLACE}>>"
#: The place that event e puts its claim in.
OF_EVENT = f"CAST(named_struct('micros', e.micros, 'rank', e.rank, 'seq', e.seq, 'state', e.state, 'confidence', e.confidence) AS {PLACE})"


def runs(events: DataFrame, bits: int = RUN_BITS) -> DataFrame:
    """The events with ``_run``: events sorted by claim and seq over all tasks, cut into runs of at most 2**bits rows.

    A claim of any length lies in as many tasks as its share of the rows asks for. The result is written once, since the
    cuts depend on a sample.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "seq"]
    ranged = events.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), bits)), "runs")


def same_run(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (claim, ``_run``), where nulls of the key are one key; the right side's copies of the key go."""
    names = [*KEY, "_run"]
    other = right.select(*[F.col(c).alias(f"_{c}_r") for c in names], *[c for c in right.columns if c not in names])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}_r")) for c in names]
    return left.join(other, on, how).drop(*[f"_{c}_r" for c in names])


def running_counts(events: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """For each flag the number of earlier events of the claim that have it: sums of runs, then rows of a run.

    Events carry ``_run``. A window over a whole claim sees one row a run only.
    """
    sums = events.groupBy(*KEY, "_run").agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in flags.items()])
    before = Window.partitionBy(*KEY).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*KEY, "_run", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in flags])
    inside = Window.partitionBy(*KEY, "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = {n: F.col(f"_{n}") + F.coalesce(F.sum(c.cast("long")).over(inside), F.lit(0)) for n, c in flags.items()}
    return same_run(events, starts, "left").withColumns(counted).drop(*[f"_{n}" for n in flags])


def _tidy(steps: str) -> str:
    """Steps in order, neighbours that end in the same place made one."""
    keep = "i = size(x) - 1 OR x[i + 1].rank <> s.rank OR x[i + 1].to.seq <> s.to.seq"
    return f"transform(array(array_sort({steps})), x -> filter(x, (s, i) -> {keep}))[0]"


def _step(steps: str, rank: str, micros: str) -> str:
    """Where the steps lead from a state; null where it stays."""
    return f"array_min(filter({steps}, t -> t.rank = {rank} AND t.hi >= {micros})).to"


def summary(log: str) -> str:
    """SQL of the steps of a run: an array of events (seq, event_type, state, rank, micros, confidence, governed)."""
    moves = "s.to.micros <= e.micros AND (e.governed OR e.rank >= s.to.rank)"
    moved = f"transform(a, s -> if({moves}, named_struct('rank', s.rank, 'hi', s.hi, 'to', {OF_EVENT}), s))"
    reach = f"if(r = -1, {FOREVER}, e.micros)"
    opens = f"(r = -1 OR e.governed OR e.rank >= r) AND NOT exists(a, s -> s.rank = r AND s.hi >= {reach})"
    added = f"transform(filter({RANKS}, r -> {opens}), r -> named_struct('rank', r, 'hi', {reach}, 'to', {OF_EVENT}))"
    joined = f"concat({moved}, CAST({added} AS {STEPS}))"
    return f"aggregate(filter({log}, e -> e.state IS NOT NULL), CAST(array() AS {STEPS}), (a, e) -> {_tidy(joined)})"


def composed(summaries: str) -> str:
    """SQL of the steps of several runs one after the other: an array of rows with ``steps``."""
    moved = f"transform(a, s -> named_struct('rank', s.rank, 'hi', s.hi, 'to', coalesce({_step('b.steps', 's.to.rank', 's.to.micros')}, s.to)))"
    added = "filter(b.steps, u -> NOT exists(a, s -> s.rank = u.rank AND s.hi >= u.hi))"
    return f"aggregate({summaries}, CAST(array() AS {STEPS}), (a, b) -> {_tidy(f'concat({moved}, {added})')})"


def _states_before(summaries: str, start: str) -> str:
    """SQL of (at, before): the state before each of the runs or blocks of an array of (at, steps)."""
    kind = f"STRUCT<seen: ARRAY<STRUCT<at: BIGINT, before: {PLACE}>>, now: {PLACE}>"
    led = _step("b.steps", "coalesce(a.now.rank, -1)", "coalesce(a.now.micros, 0L)")
    grown = "concat(a.seen, array(named_struct('at', b.at, 'before', a.now)))"
    merge = f"CAST(named_struct('seen', {grown}, 'now', coalesce({led}, a.now)) AS {kind})"
    return f"aggregate({summaries}, CAST(named_struct('seen', array(), 'now', {start}) AS {kind}), (a, b) -> {merge}, a -> a.seen)"


def states_before(summaries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(claim, _run, before): the state of the claim before each of its runs, from (claim, _run, steps) of all runs.

    Two levels: steps of up to ``block`` runs are composed to those of a block, states before blocks come first, then
    those before the runs of a block.
    """
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("_run")) - 1
    held = summaries.select(*KEY, F.col("_run").alias("at"), "steps", F.floor(number / block).alias("block"))
    blocks = held.groupBy(*KEY, "block").agg(F.array_sort(F.collect_list(F.struct("at", "steps"))).alias("members"))
    whole = blocks.withColumn("steps", F.expr(composed("members")))
    claims = whole.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "steps", "members"))).alias("blocks"))
    starts = F.arrays_zip(F.col("blocks.members").alias("members"), F.expr(_states_before("blocks", f"CAST(NULL AS {PLACE})")).alias("start"))
    rows = claims.select(*KEY, F.explode(starts).alias("z")).select(*KEY, "z.members", F.col("z.start.before").alias("start"))
    return rows.select(*KEY, F.explode(F.expr(_states_before("members", "start"))).alias("m")).select(*KEY, F.col("m.at").alias("_run"), "m.before")
