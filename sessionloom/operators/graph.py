"""Lineage over continuation edges: connected components by least-label propagation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session may name none and gets a temporary one; on a cluster,
    where executors would each write to their own disk, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage of a loop."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lineage(edges: DataFrame, depth: int = 64) -> DataFrame:
    """(node, lineage): every node of the edges (source, target) with the least node it is connected to.

    Labels spread along edges and then jump to the label of their label, so a chain takes a logarithmic number of
    rounds; an error is raised where ``depth`` rounds don't settle them.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(depth):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        now = stored(spread.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = now.where("label <> old").limit(1).count()
        labels = now.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"the lineages did not settle in {depth} rounds")
    return labels.select("node", F.col("label").alias("lineage"))


def extend_lineage(labels: DataFrame, added: DataFrame) -> DataFrame:
    """``labels`` (node, lineage) after the edges ``added`` (source, target) have come.

    The new edges are drawn between the lineages of their ends (a new node is its own), and only this small graph is searched; all other
    labels are read once, to be renamed where their lineage was merged. Earlier edges aren't read at all.
    """
    ends = added.select(F.col("source").alias("node")).unionByName(added.select(F.col("target").alias("node"))).distinct()
    known = stored(ends.join(labels, "node", "left").select("node", F.coalesce("lineage", "node").alias("lineage")), "ends")
    of = lambda end: known.select(F.col("node").alias(end), F.col("lineage").alias(f"{end}_lineage"))
    met = added.join(of("source"), "source").join(of("target"), "target").select(F.col("source_lineage").alias("source"), F.col("target_lineage").alias("target"))
    merged = lineage(met).select(F.col("node").alias("lineage"), F.col("lineage").alias("into"))
    fresh = known.join(labels.select("node"), "node", "left_anti")
    return labels.select("node", "lineage").unionByName(fresh).join(merged, "lineage", "left").select("node", F.coalesce("into", "lineage").alias("lineage"))


def shrink_lineage(labels: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """``labels`` after the edges ``removed`` have gone from ``edges``. Only lineages that hold a removed edge are searched again, along the edges
    that they have left; a node without any edge is a lineage of its own. Edges are undirected."""
    same = lambda df: df.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    touched = stored(labels.join(removed.select(F.col("source").alias("node")).distinct(), "node", "left_semi").select("lineage").distinct(), "touched")
    members = stored(labels.join(touched, "lineage", "left_semi").select("node"), "members")
    left = same(edges).join(members.select(F.col("node").alias("source")), "source", "left_semi").join(same(removed).distinct(), ["source", "target"], "left_anti")
    again = lineage(left).withColumnRenamed("lineage", "anew")
    searched = members.join(again, "node", "left").select("node", F.coalesce("anew", "node").alias("lineage"))
    return labels.join(touched, "lineage", "left_anti").select("node", "lineage").unionByName(searched)


def continuations(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Continuation edges: sessions whose turns name exactly one other earlier session."""
    named = turns.where("anchor IS NOT NULL AND anchor <> session_id").groupBy("session_id").agg(F.min("anchor").alias("anchor"), F.max("anchor").alias("last"))
    one = named.where("anchor = last").select(F.col("anchor").alias("source"), F.col("session_id").alias("target"))
    return one.join(sessions.select(F.col("session_id").alias("source")).distinct(), "source", "left_semi")


def children(sessions: DataFrame) -> DataFrame:
    """Child edges in one set-based join: a session whose parent id is another loaded session of the same workspace."""
    parents = sessions.select("workspace_id", F.col("harness_id").alias("parent_id"), F.col("session_id").alias("parent"))
    found = sessions.where("parent_id IS NOT NULL").join(parents, ["workspace_id", "parent_id"])
    return found.where("parent <> session_id").select("workspace_id", F.col("parent").alias("source"), F.col("session_id").alias("target")).distinct()


def reconcile(stored_edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """insert, keep, delete (stale derived child edges) or foreign (edges that were not derived, never touched)."""
    a = stored_edges.select("source", "target", F.col("derived").alias("_derived"), F.lit(True).alias("_has"))
    b = wanted.select("source", "target", F.lit(True).alias("_want"))
    action = F.when(F.col("_has").isNull(), "insert").when(~F.col("_derived"), "foreign").when(F.col("_want").isNull(), "delete").otherwise("keep")
    return a.join(b, ["source", "target"], "full_outer").select("source", "target", action.alias("action"))
