"""The context of hits with segments and warnings, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands
from ..sources import views


def context_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn as a hit. A turn has a segment for each 600 characters begun; every seventh session's record counts
    as redacted, and turns of over 900 characters as skipped."""
    turns = views.turns(views.table(spark, sf, "conversations"))
    turns = turns.withColumn("record_status", F.when(F.col("session_id") % 7 == 0, "redacted").otherwise("captured")).withColumn("skipped", F.length("text") > 900)
    number = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 600)))
    segments = turns.where("length(text) > 0").select("session_id", "ordinal", number.alias("k")).select("session_id", "ordinal", (F.col("session_id") * 100000 + F.col("ordinal") * 100 + F.col("k")).alias("segment_id"))
    out = bands.expand_context(turns.where("role = 'user'"), turns, segments, 3, 50)
    return out.select("session_id", "anchor", "ordinal", "distance", F.array_join(F.col("segment_ids").cast("array<string>"), ",").alias("segment_ids"), F.array_join("warnings", ",").alias("warnings"))


ORACLES = {
    "context_expansion": """WITH s AS (SELECT conv_id, turn, unnest(range(0, (length(text) - 1) // 600 + 1)) AS k FROM conversations WHERE length(text) > 0),
      l AS (SELECT conv_id, turn, string_agg((conv_id * 100000 + turn * 100 + k)::VARCHAR, ',' ORDER BY k) AS ids FROM s GROUP BY 1, 2)
      SELECT t.conv_id AS session_id, a.turn AS anchor, t.turn AS ordinal, t.turn - a.turn AS distance, coalesce(l.ids, '') AS segment_ids,
        concat_ws(',', CASE WHEN t.conv_id % 7 = 0 THEN 'record_redacted' END, CASE WHEN length(t.text) > 900 THEN 'payload_skipped' END) AS warnings
      FROM conversations a JOIN conversations t ON t.conv_id = a.conv_id AND t.turn BETWEEN a.turn - 3 AND a.turn + 20 LEFT JOIN l ON l.conv_id = t.conv_id AND l.turn = t.turn WHERE a.role = 'user'""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
