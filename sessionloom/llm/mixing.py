"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1 in turn and share ``budget`` times all sizes; a
target stops at ``most`` times its source's size and the excess is shared again by weight. That is one water level
over the sources sorted by (limit / weight), found from exact integer sums.

Selection inside a source: a document is taken whole once for each complete epoch that the target holds; the rest
of the target is filled in the order of the exponential keys -ln(u) / w, with u from a digest of the id and w the
document's quality weight, by prefix sums; the document at the limit is taken in part, so that a source meets its
target to the word. Only the place where a source ends is sought, by sums in two levels (over bucket totals, then within
the one bucket that holds it), so a source that holds a third of the rows is spread over as many tasks as it needs.

Defined cases: a null text has size 0; a document of size 0 is taken 0 times; a null source is a source of its
own, sorted last; equal keys are ordered by id and size; repeated rows are separate documents with equal keys;
an empty table gives an empty result; extra columns, whatever their names, are kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, unit_hash

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
BUDGET_HALVES = 3  # 150 %
MOST = 2
#: Rows of a source in one bucket of keys, about.
BUCKET_ROWS = 4000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: total ``source_size``, number of rows ``n`` and ``target`` (double).

    The windows run over one row per source, never over documents.
    """
    totals = sized.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    level = Window.orderBy((F.col("limit") / F.col("weight")), F.col("_source").asc_nulls_last())
    before, everything = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = totals.withColumn("weight", weight).withColumn("limit", MOST * F.col("source_size"))
    # With the k sources of least limit / weight full, the level is (budget - their limits) / (weights of the rest).
    ranked = ranked.select(
        "*",
        (BUDGET_HALVES * F.sum("source_size").over(everything) - 2 * F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("rest"),
        (2 * (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("weights"),
    )
    # The first source whose own limit is not reached at its level fixes the level for all after it.
    open_ = F.col("limit") * F.col("weights") >= F.col("rest") * F.col("weight")
    first = F.min(F.when(open_, F.struct((F.col("limit") / F.col("weight")).alias("r"), F.col("_source").isNull().alias("z"), F.col("_source").alias("s"), F.col("rest").alias("rest"), F.col("weights").alias("weights")))).over(everything)
    share = F.least((F.col("weight") * F.col("_l.rest")).cast("double") / F.col("_l.weights").cast("double"), F.col("limit").cast("double"))
    return ranked.withColumn("_l", first).select("_source", "source_size", "n", F.coalesce(share, F.col("limit").cast("double")).alias("target"))


def keyed(rows: DataFrame, quality: DataFrame | None, id_col: str) -> DataFrame:
    """``rows`` with the exponential key of their doc_id as ``_key``."""
    if quality is not None:
        quality = quality.groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_quality"))
        rows = rows.join(quality, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        rows = rows.withColumn("_quality", F.lit(None).cast("int"))
    weight = F.when(F.col("_quality") > 0, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    u = unit_hash(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("mix"))
    return rows.withColumn("_key", -F.log(u) / weight).drop("_quality")


def limits(groups: DataFrame) -> DataFrame:
    """One row per source: source_size, target, the complete ``_epochs`` in it, and where the rest of the target ends: at the
    place ``_end`` (key, doc_id, size), which ``_same`` rows share, after ``_part`` words of them.

    ``groups`` has a row for each doc_id, source and size, with ``_key`` and the number ``_same`` of its rows; no text.
    """
    groups = groups.withColumn("_words", F.col("size") * F.col("_same"))
    whole = F.round("target").cast("long")
    targets = source_targets(groups, size="_words").withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("_rest", whole - F.col("_epochs") * F.col("source_size"))
    rows = groups.join(targets.select("_source", "n"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # keys are exponential, so 1 - exp(-key) is near uniform where weights are 1 and cuts a source into buckets of like size;
    # with exp(-key / 2) on the way, neither weight gathers its rows at an end
    spread = 1 - (F.exp(-F.col("_key") / 2) + F.exp(-F.col("_key")) + F.exp(-2 * F.col("_key"))) / 3
    rows = rows.withColumn("_bucket", F.floor(spread * F.ceil(F.col("n") / BUCKET_ROWS)).cast("long"))
    # first the bucket in which the rest ends, then the place in it
    sums = rows.groupBy("source", "_bucket").agg(F.sum("_words").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_left", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    sums = sums.join(targets.select("_source", "_rest"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_left", F.col("_rest") - F.col("_left"))
    last = sums.where("_left >= 0 AND _left < _sum").select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_left")
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    rows = rows.withColumn("_part", F.col("_left") - F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    ends = rows.where("_part >= 0 AND _part < _words").select("_s", F.struct("_key", "doc_id", "size").alias("_end"), "_same", "_part")
    return targets.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s", "_rest", "n")


def choose(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc`` (a struct of all columns of ``docs``), doc_id, source, size, source_size, target and taken (words that the mix
    takes, repeats counted).

    ``quality`` may give (id, quality 0 or 1): weights 2 and 0.5; documents without one weigh 1. The order and the sums are
    worked on without the texts; a text then meets its quality and the limit of its source.
    """
    base = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size")]
    groups = docs.select(*base).groupBy("doc_id", "source", "size").agg(F.count("*").alias("_same"))
    groups = materialize(keyed(groups, quality, id_col), "mix_groups")
    # a row per source, written, so that Spark knows its size and broadcasts it only while that is small
    ends = materialize(limits(groups), "mix_limits")
    discard(groups)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *base, F.xxhash64(F.col(f"`{text}`")).alias("_tie"))
    rows = keyed(docs.drop("_tie"), quality, id_col).join(ends, F.col("source").eqNullSafe(F.col("_source")))
    place = F.struct("_key", "doc_id", "size")
    rest = F.when(place < F.col("_end"), F.col("size")).when(place == F.col("_end"), F.col("_part")).otherwise(0)
    tied = ends.where("_same > 1")
    out = ["doc", "doc_id", "source", "size", "source_size", "target"]
    if not tied.head(1):
        return rows.select(*out, (F.col("_epochs") * F.col("size") + rest).alias("taken"))
    # rows that share the place at a limit are filled one after the other
    rows = rows.where(F.coalesce((F.col("_same") == 1) | (place != F.col("_end")), F.lit(True)))
    same = docs.join(tied, F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_end.doc_id")) & (F.col("size") == F.col("_end.size")))
    before = (F.row_number().over(Window.partitionBy("source").orderBy("_tie")) - 1) * F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_part") - before))
    return rows.select(*out, (F.col("_epochs") * F.col("size") + rest).alias("taken")).union(same.select(*out, (F.col("_epochs") * F.col("size") + part).alias("taken")))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents with the columns of ``docs``, whatever their names: a row for each whole copy and one for a part.

    The part is the document's first words; only the document at the limit of a source has one.
    """
    chosen = choose(docs, quality, id_col, text, source).where("taken > 0")
    rows = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    rows = rows.withColumn("left", (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("long"))
    # the first words: cut the text at the end of the last of them
    whole = F.col("doc").getField(text)
    parts = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("cut", F.when(F.col("left") < F.col("size"), F.array_join(F.slice(parts, F.lit(1), F.col("left").cast("int")), "")).otherwise(whole))
    new = {text: F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def mixing_report(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The contract's columns."""
    # the columns go in by themselves, so the struct that nothing reads is pruned
    return choose(docs.select("doc_id", "text", "source"), quality).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT a.source, 3 * (SELECT sum(source_size) FROM totals) - 2 * coalesce(sum(2 * b.source_size), 0) AS rest,
         2 * ((SELECT sum(weight) FROM totals) - coalesce(sum(b.weight), 0)) AS weights,
         any_value(a.weight) AS weight, any_value(2 * a.source_size) AS lim
  FROM totals a LEFT JOIN totals b
    ON (2 * b.source_size) / b.weight < (2 * a.source_size) / a.weight
    OR ((2 * b.source_size) / b.weight = (2 * a.source_size) / a.weight AND coalesce(b.source < a.source, b.source IS NOT NULL))
  GROUP BY a.source),
lvl AS (
  SELECT rest, weights FROM levels WHERE lim * weights >= rest * weight ORDER BY lim / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT t.source, t.source_size,
         least((t.weight * l.rest)::DOUBLE / l.weights::DOUBLE, (2 * t.source_size)::DOUBLE) AS target
  FROM totals t, lvl l),
quality AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
keyed AS (
  SELECT s.doc_id, s.size, t.source, t.source_size, t.target,
         -ln((('0x' || substr(md5(s.doc_id || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / CASE WHEN q.quality > 0 THEN 2.0::DOUBLE WHEN q.quality = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN quality q ON q.doc_id = s.doc_id),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS epochs
  FROM keyed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target) - epochs * source_size - before)))::BIGINT AS taken
FROM summed
"""
