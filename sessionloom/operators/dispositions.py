"""Edges between findings: the contract of an edge, and targets of other records, which must lie in the lineage of their session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sessions import DISPOSITION_KINDS


def form_codes(edges: DataFrame) -> DataFrame:
    """``edges`` (kind, from_key, to_key, to_finding_id) with ``code``: a kind that isn't known, no source, or not exactly one form of target.

    Empty texts and texts of white space count as missing.
    """
    given = lambda c: F.coalesce(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kind = F.coalesce(F.col("kind").isin(*DISPOSITION_KINDS), F.lit(False))
    code = F.when(~kind, "bad_kind").when(~given("from_key"), "empty_source").when(given("to_key") == given("to_finding_id"), "target_form")
    return edges.withColumn("code", code)


def resolve(edges: DataFrame, findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (workspace_id, session_id, record_id, kind, from_key, to_key, to_finding_id) with ``source``, ``target``, ``external`` and ``code``.

    A key is looked up among the findings (workspace_id, session_id, record_id, key, finding_id) of the edge's own record, a finding id among
    those of all records of the workspace; the session of such a target must share the label of the edge's session in ``labels``
    (workspace_id, node, lineage), where a session without a label is alone. The first reason for a refusal is the code: those of
    ``form_codes``, then unknown_source, unknown_target, outside_lineage and self_edge. Every look-up is an equi-join with one row for a key, so
    an edge stays one row. Of several findings with one key in a record the least id is taken.
    """
    own = findings.groupBy("workspace_id", "record_id", "key").agg(F.min("finding_id").alias("found"))
    source = own.withColumnsRenamed({"key": "from_key", "found": "source"})
    local = own.withColumnsRenamed({"key": "to_key", "found": "local_target"})
    far = findings.groupBy("workspace_id", F.col("finding_id").alias("to_finding_id")).agg(F.min("session_id").alias("target_session"))
    label = lambda node, name: labels.select("workspace_id", F.col("node").alias(node), F.col("lineage").alias(name))
    rows = form_codes(edges).join(source, ["workspace_id", "record_id", "from_key"], "left")
    rows = rows.join(local, ["workspace_id", "record_id", "to_key"], "left").join(far, ["workspace_id", "to_finding_id"], "left")
    rows = rows.join(label("session_id", "line"), ["workspace_id", "session_id"], "left").join(label("target_session", "target_line"), ["workspace_id", "target_session"], "left")
    external = F.col("to_finding_id").isNotNull()
    target = F.when(external, F.when(F.col("target_session").isNotNull(), F.col("to_finding_id"))).otherwise(F.col("local_target"))
    apart = F.coalesce("line", "session_id") != F.coalesce("target_line", "target_session")
    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("source").isNull(), "unknown_source")
        .when(target.isNull(), "unknown_target")
        .when(external & apart, "outside_lineage")
        .when(F.col("source") == target, "self_edge")
    )
    return rows.select("workspace_id", "session_id", "record_id", "kind", "source", target.alias("target"), external.alias("external"), code.alias("code"))
