"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node with more than this share of all edges, and more than so many, is a hub; so there are fewer hubs than 2 / share.
HUB_SHARE, HUB_LEAST = 1 / 1000, 64


def _star(edges: DataFrame, small: bool, hub: int) -> DataFrame:
    """One round. A node's smallest neighbour comes from a combined aggregate and is joined back. The edges of a hub are
    dealt out by salt, about ``hub`` of them to each, so no task gathers them all; the list of hubs is bounded by its share."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select(F.col("u").alias("n"), F.least(F.col("u"), F.col("m")).alias("m"), F.ceil(F.col("k") / hub).cast("int").alias("salts"))
    hubs = F.broadcast(least.where("salts > 1").select(F.col("n").alias("h"), F.col("salts").alias("hs")))
    dealt = both.join(hubs, F.col("u") == F.col("h"), "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("hs")), F.lit(0)).cast("int").alias("salt"))
    spread = least.select("n", "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("at"))
    rows = dealt.join(spread, (F.col("u") == F.col("n")) & (F.col("salt") == F.col("at")))
    if small:  # edges are (larger, smaller): the smaller neighbours and the node itself go to the least
        moved = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    else:  # strictly larger neighbours go to the least
        moved = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the least node reachable. Nodes without an edge are absent.

    Every round is written to the shared scratch folder and the one before it deleted; the loop ends when a round changes
    nothing. It is an error if none of ``rounds`` rounds does so.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    measure = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = measure(now)
    for _ in range(rounds):
        hub = max(HUB_LEAST, int(before[0] * HUB_SHARE))
        last, now = now, materialize(_star(_star(now, False, hub), True, hub), "edges")
        discard(last)
        state = measure(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
