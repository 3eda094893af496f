"""Links between close vectors by spherical-cap locality-sensitive filters.

Filter directions are the words of a structured random product code: the coordinates are cut into two blocks, each
with a random code of unit vectors, and every pair of block words is a direction. A vector is list-decoded to all
directions that it exceeds the cap height for: only block words that can still reach the height with the best word of the
other block are combined. The height is the quantile of the exact law of a unit vector's product with a direction, so that
``FILTERS`` filters a vector are to be expected whatever the code's size; a vector that exceeds fewer than ``LEAST``
is given its best so many, with a lower cap of its own. Vectors with a common filter and label are candidates. The
code grows with the number of vectors so that a filter's expected load stays constant.

A crowd of near-equal vectors would make all its pairs; instead each vector within half the link angle of the least
vector of one of its buckets joins that vector's ball. All members of a ball are linked by the triangle inequality
of angles, as are two balls whose centres and radii leave no doubt; only pairs of balls in doubt are compared member
by member, in double precision. So the number of links is exact for all pairs that the filters find, while pairs
are made only where something has to be decided.

Defined cases: a null label, or a vector that is null, zero, has null or non-finite components or another length
than most, links with nothing; repeated rows of one id are one vector (the least) and each returns its row; ties
need no order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize
from .graph import components

COSINE = 0.93
#: Filters of a vector, expected, and at least. Over codes of 256 to 4096 words, 1500 isotropic pairs each at cosine 0.93 to 0.95:
#: all share a filter; with no least number 0.91 to 0.95 of them do.
FILTERS, LEAST = 40, 40
#: From so many dimensions on the coordinates are cut into two blocks; halves of fewer have too few different directions.
SPLIT = 8
#: Bytes of the block products that a task holds at once.
DECODED = 32 << 20
#: Angles are trusted to this much (radians) where the triangle inequality stands in for a comparison.
MARGIN = 1e-6


def cap_height(dims: int, share: float, steps: int = 400_000) -> float:
    """The product with a fixed unit direction that a random unit vector exceeds with probability ``share``.

    Its density is (1 - t²)^((dims - 3) / 2) on [-1, 1], summed up from the top at midpoints.
    """
    t = 1 - (np.arange(steps) + 0.5) * (2 / steps)
    mass = np.cumsum(np.exp((dims - 3) / 2 * np.log1p(-t * t)))
    return float(t[np.searchsorted(mass, share * mass[-1])])


class ProductCode:
    """Two random block codes of ``words`` unit vectors and the cap height that gives ``FILTERS`` filters. Vectors of under
    ``SPLIT`` dimensions have one block, beside an empty one of a single word."""

    def __init__(self, dims: int, words: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.cut = dims // 2 if dims >= SPLIT else 0
        self.codes = []
        for width in (self.cut, dims - self.cut):
            code = rng.standard_normal((words, width)) if width else np.zeros((1, 0))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) if width else code)
        self.words = words
        # a direction is a word of each block, so it has the norm sqrt(2), or 1 where there is one block
        self.height = cap_height(dims, min(0.5, FILTERS / (words * len(self.codes[0])))) * math.sqrt(2 if self.cut else 1)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The numbers of all filters that each unit vector exceeds. Block products are held for a bounded number of rows."""
        rows = max(1, DECODED // (16 * self.words))
        return [found for at in range(0, len(unit), rows) for found in self._decode(unit[at : at + rows])]

    def _decode(self, unit: np.ndarray) -> list[np.ndarray]:
        one = unit[:, : self.cut] @ self.codes[0].T
        two = unit[:, self.cut :] @ self.codes[1].T
        out = []
        for a, b in zip(one, two, strict=True):
            i = np.flatnonzero(a >= self.height - b.max())
            j = np.flatnonzero(b >= self.height - a.max())
            x, y = np.nonzero(a[i][:, None] + b[j][None, :] >= self.height)
            out.append(i[x] * self.words + j[y] if len(x) >= LEAST else self._best(a, b))
        return out

    def _best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ``LEAST`` filters of greatest product; their words are among the best so many of each block."""
        i, j = np.argsort(-a, kind="stable")[:LEAST], np.argsort(-b, kind="stable")[:LEAST]
        both = (a[i][:, None] + b[j][None, :]).ravel()
        x, y = np.divmod(np.argsort(-both, kind="stable")[:LEAST], len(j))
        return i[x] * self.words + j[y]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims)


def _angles(pairs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """``pairs`` (a, b, ...) with ``cosine`` in double precision."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(len(names)), dims), _matrix(batch.column(len(names) + 1), dims)
                cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(cosine)], [*names, "cosine"])

    rows = pairs.join(vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("_x")), "a").join(vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("_y")), "b")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return rows.select(*names, "_x", "_y").mapInArrow(run, f"{kinds}, cosine double")


def links(table: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(balls, members, edges): (ball, n members, least member, k_all links of each member to its own and to wholly linked
    balls); (vec_id, ball, k_own links decided one by one); linked balls (u, v)."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select("vec_id", "label", "embedding").where(usable & fine & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    dims, count = (lengths[0]["d"], lengths[0]["n"]) if lengths else (1, 0)
    rows = rows.where(F.size("embedding") == dims).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("s")).select("vec_id", "s.label", "s.embedding")
    vectors = materialize(rows, "vectors")
    code_words = max(32, 1 << math.ceil(math.log2(math.sqrt(8 * max(count, 1)))))
    half = math.acos(cosine) / 2 - MARGIN

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ProductCode(dims, code_words)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), dims)
                found = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
                n = np.array([len(f) for f in found])
                reps = np.repeat(np.arange(batch.num_rows), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(reps)), batch.column(1).take(pa.array(reps)), pa.array(np.concatenate(found).astype(np.int64))], ["vec_id", "label", "filter"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    found = materialize(vectors.select("vec_id", "label", "embedding").mapInArrow(filters, f"vec_id {kinds['vec_id']}, label {kinds['label']}, filter long"), "filters")
    pivots = found.groupBy("label", "filter").agg(F.min("vec_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    tries = found.join(pivots, ["label", "filter"]).where("vec_id <> pivot").select(F.col("vec_id").alias("a"), F.col("pivot").alias("b")).distinct()
    near = _angles(tries, vectors, dims).where(F.col("cosine") >= math.cos(half))
    centre = near.groupBy("a").agg(F.min(F.struct("b", "cosine")).alias("c")).select("a", F.col("c.b").alias("centre"), F.acos(F.least(F.col("c.cosine"), F.lit(1.0))).alias("r"))
    balls = vectors.select("vec_id").join(centre, F.col("vec_id") == F.col("a"), "left")
    balls = materialize(balls.select("vec_id", F.coalesce("centre", "vec_id").alias("ball"), F.coalesce("r", F.lit(0.0)).alias("r")), "balls")
    sizes = materialize(balls.groupBy("ball").agg(F.count("*").alias("n"), F.max("r").alias("radius"), F.min("vec_id").alias("least")), "sizes")
    there = materialize(found.join(balls.select("vec_id", "ball"), "vec_id").select("label", "filter", "ball").distinct(), "there")
    pairs = there.withColumnRenamed("ball", "a").join(there.withColumnRenamed("ball", "b"), ["label", "filter"]).where("a < b").select("a", "b").distinct()
    side = lambda k: sizes.select(F.col("ball").alias(k), F.col("n").alias(f"n_{k}"), F.col("radius").alias(f"r_{k}"))
    known = _angles(pairs.join(side("a"), "a").join(side("b"), "b"), vectors, dims)
    angle, spread = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("cosine"), F.lit(1.0)))), F.col("r_a") + F.col("r_b")
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1) & (spread == 0)
    sure = F.when(single, F.col("cosine") >= cosine).when(angle + spread <= math.acos(cosine) - MARGIN, True).when(angle - spread > math.acos(cosine) + MARGIN, False)
    known = materialize(known.withColumn("linked", sure).select("a", "b", "n_a", "n_b", "linked"), "verdicts")
    member = lambda k, v: balls.select(F.col("ball").alias(k), F.col("vec_id").alias(v))
    doubt = known.where("linked IS NULL").select(F.col("a").alias("ball_a"), F.col("b").alias("ball_b"))
    doubt = doubt.join(member("ball_a", "a"), "ball_a").join(member("ball_b", "b"), "ball_b").select("a", "b", "ball_a", "ball_b")
    decided = materialize(_angles(doubt, vectors, dims).where(F.col("cosine") >= cosine), "decided")
    whole = known.where("linked")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("n_b").alias("k")).unionByName(whole.select(F.col("b").alias("ball"), F.col("n_a").alias("k"))).groupBy("ball").agg(F.sum("k").alias("k_ball"))
    by_vector = decided.select(F.col("a").alias("vec_id")).unionByName(decided.select(F.col("b").alias("vec_id"))).groupBy("vec_id").agg(F.count("*").alias("k_own"))
    per_ball = sizes.join(by_ball, "ball", "left").select("ball", "n", "least", (F.col("n") - 1 + F.coalesce("k_ball", F.lit(0))).alias("k_all"))
    members = balls.select("vec_id", "ball").join(by_vector, "vec_id", "left")
    edges = whole.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(decided.select(F.col("ball_a").alias("u"), F.col("ball_b").alias("v"))).distinct()
    return per_ball, members, edges


def link_report(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The contract's columns, one row per row of the table."""
    per_ball, members, edges = links(table, cosine)
    roots = materialize(components(edges), "roots")
    balls = per_ball.join(roots, F.col("ball") == F.col("node"), "left").withColumn("root", F.coalesce("root", "ball"))
    least = balls.groupBy("root").agg(F.min("least").alias("component_id"))
    balls = materialize(balls.join(least, "root").select("ball", "n", "k_all", "component_id"), "components")
    found = hot_join(members, balls, "ball", "n", "vec_id").select("vec_id", (F.col("k_all") + F.coalesce("k_own", F.lit(0))).alias("n_links"), "component_id")
    rows = table.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
