"""Rows near anchors on a line of ordinals: a band join that stays an equi-join, and the context of hits made with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(anchors: DataFrame, rows: DataFrame, key: str, at: str, anchor: str, before: int, after: int) -> DataFrame:
    """``rows`` whose ``at`` lies from ``before`` below to ``after`` above an anchor of the same ``key``, with the anchor.

    Ordinals are cut into buckets as wide as the window, so an anchor's window lies in two of them at most and rows meet
    it by (key, bucket). A key with very many rows is spread over its buckets, and the pairs made are at most twice those
    of two windows for each anchor, however long the key is. Null keys and ordinals meet nothing.
    """
    width = before + after + 1
    bucket = lambda c: F.floor(c / F.lit(width))
    marks = anchors.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(anchor) - before), bucket(F.col(anchor) + after))))
    near = rows.withColumn("_bucket", bucket(F.col(at))).join(marks, [key, "_bucket"])
    return near.where(F.col(at).between(F.col(anchor) - before, F.col(anchor) + after)).drop("_bucket")


def expand_context(anchors: DataFrame, turns: DataFrame, segments: DataFrame, before: int = 2, after: int = 2, most: int = 20) -> DataFrame:
    """The turns around each anchor turn (session_id, ordinal) with their segments and warnings.

    Turns have session_id, ordinal, record_status and skipped; segments session_id, ordinal and segment_id. A turn without
    segments stays, with none. Warnings: ``record_redacted`` where the turn's record was redacted, ``payload_skipped`` where
    its payload was left out. Either side of the window is held to 0 to ``most``.
    """
    before, after = min(max(before, 0), most), min(max(after, 0), most)
    marks = anchors.select("session_id", F.col("ordinal").alias("anchor"))
    near = band_join(marks, turns, "session_id", "ordinal", "anchor", before, after)
    listed = segments.groupBy("session_id", "ordinal").agg(F.array_sort(F.collect_list("segment_id")).alias("segment_ids"))
    warnings = F.array_compact(F.array(F.when(F.col("record_status") == "redacted", "record_redacted"), F.when(F.col("skipped"), "payload_skipped")))
    rows = near.join(listed, ["session_id", "ordinal"], "left")
    return rows.select("session_id", "anchor", "ordinal", (F.col("ordinal") - F.col("anchor")).alias("distance"), F.coalesce("segment_ids", F.array().cast("array<bigint>")).alias("segment_ids"), warnings.alias("warnings"))
