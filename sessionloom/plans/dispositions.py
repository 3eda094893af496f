"""Lineages kept as edges come and go, and the targets of findings within them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dispositions, graph
from ..sources import views


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return views.continuation_edges(views.table(spark, sf, "conversations"))


def lineage_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the edges of even sources, extended by those of odd ones, then without those of every seventh target."""
    edges = _edges(spark, sf)
    even = F.col("source") % 2 == 0
    labels = graph.stored(graph.extend_lineage(graph.lineage(edges.where(even)), edges.where(~even)), "labels")
    return graph.shrink_lineage(labels, edges, edges.where("target % 7 = 0"))


def _finding(session: Column, turn: Column) -> Column:
    return F.concat_ws("/", session.cast("string"), turn.cast("string"))


def disposition_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A record per conversation, a finding per turn; each turn builds on one of another record, of its own record, or is in bad form."""
    turns = views.table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    place = F.lit("w").alias("workspace_id"), F.col("conv_id").alias("session_id"), F.col("conv_id").cast("string").alias("record_id")
    findings = turns.select(*place, F.concat(F.lit("k"), F.col("turn").cast("string")).alias("key"), _finding(F.col("conv_id"), F.col("turn")).alias("finding_id"))
    way = (F.col("conv_id") + 3 * F.col("turn")) % 8
    back = F.concat(F.lit("k"), (F.col("turn") - F.when(way == 5, 0).otherwise(1)).cast("string"))
    other = _finding(F.col("conv_id") + F.element_at(F.array(*[F.lit(x) for x in (1, -1, 2, 5)]), (way % 4 + 1).cast("int")), F.lit(0))
    edges = turns.select(
        *place,
        F.when(F.col("role") == "user", "refutes").when(F.col("role") == "assistant", "builds_on").otherwise("cites").alias("kind"),
        F.concat(F.lit("k"), F.col("turn").cast("string")).alias("from_key"),
        F.when(way > 3, back).alias("to_key"),
        F.when((way < 4) | (way == 6), other).when(way == 4, F.lit(" ")).alias("to_finding_id"),
    )
    # blanks are no finding
    edges = edges.withColumn("to_finding_id", F.when(F.trim("to_finding_id") != "", F.col("to_finding_id")))
    labels = graph.lineage(_edges(spark, sf)).select(F.lit("w").alias("workspace_id"), "node", "lineage")
    return dispositions.resolve(edges, findings, labels).select("record_id", "kind", "source", "target", "external", "code")


#: The least session that a session reaches by going down the chain of five, as long as each edge is there.
_LINE = """e AS (SELECT DISTINCT a.conv_id AS source, a.conv_id + 1 AS target FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 5 <> 4),
  walk(node, low) AS (SELECT node, node FROM (SELECT source AS node FROM e UNION SELECT target FROM e) UNION ALL SELECT node, source FROM walk JOIN {kept} k ON k.target = walk.low),
  lin AS (SELECT node, min(low) AS lineage FROM walk GROUP BY 1)"""

ORACLES = {
    "lineage_updates": f"WITH RECURSIVE {_LINE.format(kept='(SELECT * FROM e WHERE target % 7 <> 0)')} SELECT node, lineage FROM lin",
    "disposition_targets": f"""WITH RECURSIVE {_LINE.format(kept='e')}, c AS (SELECT conv_id, turn, role, (conv_id + 3 * turn) % 8 AS way FROM conversations),
      t AS (SELECT *, CASE role WHEN 'user' THEN 'refutes' WHEN 'assistant' THEN 'builds_on' ELSE 'cites' END AS kind, CASE WHEN way < 4 OR way = 6 THEN conv_id + [1, -1, 2, 5][way % 4 + 1] END AS far, CASE WHEN way > 3 THEN turn - CASE WHEN way = 5 THEN 0 ELSE 1 END END AS near FROM c),
      f AS (SELECT DISTINCT conv_id, turn FROM conversations),
      j AS (SELECT t.*, a.conv_id AS far_found, b.turn AS near_found, coalesce(l.lineage, t.conv_id) AS line, coalesce(m.lineage, a.conv_id) AS far_line FROM t LEFT JOIN f a ON a.conv_id = t.far AND a.turn = 0 LEFT JOIN f b ON b.conv_id = t.conv_id AND b.turn = t.near
        LEFT JOIN lin l ON l.node = t.conv_id LEFT JOIN lin m ON m.node = t.far)
      SELECT conv_id::VARCHAR AS record_id, kind, conv_id || '/' || turn AS source, CASE WHEN far IS NOT NULL THEN far_found || '/0' ELSE conv_id || '/' || near_found END AS target, far IS NOT NULL AS external,
        CASE WHEN kind = 'cites' THEN 'bad_kind' WHEN way = 6 THEN 'target_form' WHEN far IS NOT NULL AND far_found IS NULL THEN 'unknown_target' WHEN far IS NULL AND near_found IS NULL THEN 'unknown_target'
          WHEN far IS NOT NULL AND line <> far_line THEN 'outside_lineage' WHEN far IS NULL AND near = turn THEN 'self_edge' END AS code FROM j""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
