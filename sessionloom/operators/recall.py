"""Retrieval for batches of queries: trigram, lexical and vector candidates, hybrid ranking, groups and context."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search
from .bands import band_join

TRIGRAM_WEIGHT, VECTOR_WEIGHT = 0.35, 0.75
#: Scores rounded to six digits tie within this.
SLACK = 2e-6
BLOCK = 2048


def eligible(segments: DataFrame, sessions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Segments of enabled bindings and active snapshots."""
    return segments.join(sessions.where("enabled").select("session_id"), "session_id", "left_semi").join(snapshots.where("is_active").select("record_id"), "record_id", "left_semi")


def top(hits: DataFrame, limit: int, order: list) -> DataFrame:
    """The first hits of each query with their rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)


def first_of_texts(segments: DataFrame, most: int) -> DataFrame:
    """(segment_id, text, place, lead): the first ``most`` segments of each distinct text; ``lead`` is the text's least id."""
    place = F.row_number().over(Window.partitionBy("text").orderBy("segment_id"))
    rows = segments.select("segment_id", "text", place.alias("place")).where(F.col("place") <= most)
    return rows.withColumn("lead", F.min("segment_id").over(Window.partitionBy("text")))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """(query, query_id): the distinct queries, each under its least id."""
    return queries.groupBy("query").agg(F.min("query_id").alias("query_id"))


def spread(hits: DataFrame, firsts: DataFrame, queries: DataFrame, most: int, order: list) -> DataFrame:
    """Hits between distinct queries and distinct texts, as the first ``most`` hits of each query among all segments.

    A text's segments share its score. The first ``most`` segments in an order that ends in the id lie in the first
    ``most`` texts by that order and their least ids, and each is among the first ``most`` of its text. So copies are
    scored once and no more than ``most`` of them are ever listed. ``firsts``: :func:`first_of_texts` of ``most``.
    """
    order = [*order, "segment_id"]
    near = top(hits, most, order).drop("rank").withColumnRenamed("segment_id", "lead").join(firsts.select("lead", "segment_id"), "lead").drop("lead")
    near = top(near, most, order).drop("rank").withColumnRenamed("query_id", "lead")
    leads = queries.join(distinct_queries(queries).withColumnRenamed("query_id", "lead"), "query").select("query_id", "lead")
    return leads.join(near, "lead").drop("lead")


def word_similarity(query: list[str], text: list[str]) -> float:
    """The greatest Jaccard similarity of the query's trigrams to a window of the text's ordered trigrams.

    A best window starts at a trigram of the query. A trigram counts in a window where it has no earlier place there.
    """
    asked, last = set(query), {}
    before, inside = np.empty(len(text), dtype=np.int64), np.empty(len(text), dtype=bool)
    for i, t in enumerate(text):
        before[i], inside[i] = last.get(t, -1), t in asked
        last[t] = i
    best, starts = 0.0, np.flatnonzero(inside)
    step = max(1, (1 << 20) // max(1, len(text)))
    for at in range(0, len(starts), step):
        first = starts[at : at + step, None]
        new = (before[None, :] < first) & (np.arange(len(text))[None, :] >= first)
        both = np.cumsum(new & inside[None, :], axis=1)
        best = max(best, float((both / (len(asked) + np.cumsum(new, axis=1) - both)).max()))
    return best


def trigram_bounds(segments: DataFrame, queries: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, segment_id, low, high) of the pairs that can reach ``least``, through an inverted trigram index.

    The trigram score is the greater of similarity and word similarity, which is the latter: the whole text is a window
    too. So similarity bounds it from below, and the share of the query's trigrams that the text holds from above.
    A pair must share ceil(least * |query|) trigrams, so one of the query's rarest |query| - that + 1 trigrams; only
    those are looked up, which keeps very common trigrams out of the join.
    """
    posted = segments.select("segment_id", F.explode(T.trigrams(F.col("text"))).alias("t"))
    spread = posted.groupBy("t").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", T.trigrams(F.col("query")).alias("q"))
    each = asked.select("query_id", F.size("q").alias("n"), F.explode("q").alias("t")).join(spread, "t", "left")
    ordered = each.groupBy("query_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("o"))
    rare = ordered.select("query_id", F.explode(F.slice("o", 1, F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1)).alias("x")).select("query_id", F.col("x.t").alias("t"))
    pairs = posted.join(rare, "t").select("query_id", "segment_id").distinct()
    sides = pairs.join(asked, "query_id").join(segments.select("segment_id", T.trigrams(F.col("text")).alias("g")), "segment_id")
    both = F.size(F.array_intersect("q", "g"))
    rows = sides.select("query_id", "segment_id", (both / (F.size("q") + F.size("g") - both)).alias("low"), (both / F.size("q")).alias("high"))
    return rows.where(F.col("high") >= least)


def trigram_scores(pairs: DataFrame, segments: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` (query_id, segment_id, ...) with ``trigram``, the exact score; 0 where either text is missing."""
    asked = queries.select("query_id", T.trigrams(F.col("query")).alias("_q"))
    both = pairs.join(asked, "query_id", "left").join(segments.select("segment_id", T.ordered_trigrams(F.col("text")).alias("_g")), "segment_id", "left")

    names = pairs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, q, g = batch.columns
            found = [word_similarity(x, y) if x and y else 0.0 for x, y in zip(q.to_pylist(), g.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], [*names, "trigram"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in pairs.columns)
    # a pair is little data and much work: by bytes, all pairs could be one task
    dealt = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "segment_id")
    return dealt.select(*pairs.columns, "_q", "_g").mapInArrow(score, f"{kinds}, trigram double")


def hopeful(rows: DataFrame, limit: int, low: Column, high: Column, sure: Column | None = None, slack: float = 1e-9) -> DataFrame:
    """The rows that may be among the first ``limit`` of their query, given bounds of their scores. ``slack``: by how much
    lower scores may still tie, where rows are ordered by rounded ones.

    The limit-th greatest lower bound (of rows that are ``sure`` to stay) is found with at most ``limit`` rows a query and task.
    """
    bar = rows.where(sure) if sure is not None else rows
    bar = top(bar.select("query_id", low.alias("low")), limit, [F.col("low").desc()]).where(F.col("rank") == limit).select("query_id", F.col("low").alias("_bar"))
    return rows.join(bar, "query_id", "left").where(F.col("_bar").isNull() | (high >= F.col("_bar") - slack)).drop("_bar")


def trigram_hits(segments: DataFrame, queries: DataFrame, limit: int | None = None, least: float = 0.3) -> DataFrame:
    """(query_id, segment_id, trigram) of the hits at or above the threshold.

    With ``limit``, a text's own query is left out and so is what cannot be among a query's first ``limit`` hits by score
    and id: distinct texts are compared with distinct queries, and exact scores are computed only where the bounds leave a doubt.
    """
    if limit is None:
        rows = trigram_bounds(segments, queries, least)
        return trigram_scores(rows.select("query_id", "segment_id"), segments, queries).where(F.col("trigram") >= least)
    firsts, asked = first_of_texts(segments, limit + 1), distinct_queries(queries)  # one more: the own one goes
    texts = firsts.where("place = 1")
    rows = hopeful(trigram_bounds(texts, asked, least), limit + 1, F.col("low"), F.col("high"))
    found = trigram_scores(rows.select("query_id", "segment_id"), texts, asked).where(F.col("trigram") >= least)
    return spread(found, firsts, queries, limit + 1, [F.col("trigram").desc()]).where("query_id <> segment_id")


def lexical_hits(segments: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Rows that hold a query's first ``limit`` segments with all required terms and none of the excluded, by rank and id.

    The rank is 1 / (length of the shortest window that covers all terms). ``queries``: query_id, required, excluded. Rows of
    one query or segment id are queries and segments of their own.
    """
    asked = queries.select("query_id", F.array_distinct("required").alias("required"), "excluded")
    item = lambda t, slot, negative: F.struct(F.lit(0).alias("clause"), slot.cast("int").alias("slot"), F.lit(negative).alias("negative"), F.array(t).alias("terms"), F.size("required").alias("k"))
    wanted, banned = F.transform("required", lambda t, i: item(t, i, False)), F.transform("excluded", lambda t: item(t, F.lit(None), True))
    items = F.concat(wanted, F.coalesce(banned.cast(search.ITEMS), F.array().cast(search.ITEMS)))
    return search.first_matches(segments, asked.select("query_id", items.alias("items")), T.analyzed, limit, search.shortest, merged=False)


def _blocks(vectors: DataFrame, ids: str, dims: int) -> DataFrame:
    """Rows of up to BLOCK usable vectors: ids and a matrix of unit vectors in double precision."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()])], ["ids", "m"])

    fine = vectors.where((F.size("embedding") == dims) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0))
    return fine.select(F.col(ids).cast("long"), "embedding").mapInArrow(pack, "ids array<long>, m binary")


def _best(score: np.ndarray, least: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the first ``k`` of each row by the score to nine digits and the id, of those at or above ``least``.

    The score's digits are those of the result: what ties there ties here. Negative scores are 0, excluded ones are below -1.
    """
    np.maximum(score, 0.0, out=score, where=score > -1.5)
    if score.shape[1] > k and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
    row, column = np.nonzero((score >= least[:, None] - 2e-9) & (score > -1.5))
    found = np.floor(score[row, column] * 1e9 + 0.5) / 1e9
    order = np.lexsort((ids[column], -found, row))
    row, column, found = row[order], column[order], found[order]
    some = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[some], column[some], found[some]


def knn(vectors: DataFrame, queries: DataFrame, k: int, dims: int, own: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine neighbours of a stated query set against all rows, a query's own id
    among them only with ``own``.

    Both sides are cut into blocks; a pair of blocks is one matrix product that keeps k rows a query at most, and only
    those that reach what the query's k-th row had in an earlier block of the task.
    """
    left = _blocks(vectors, "vec_id", dims).select(F.col("ids").alias("v"), F.col("m").alias("vm"))
    right = _blocks(queries, "vec_id", dims).select(F.col("ids").alias("q"), F.col("m").alias("qm"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[bytes, np.ndarray] = {}  # by block of queries: a score that k rows of each have reached
        for batch in batches:
            for i in range(batch.num_rows):
                (v, q), (vm, qm) = (batch.column(c)[i].values.to_numpy() for c in ("v", "q")), (np.frombuffer(batch.column(c)[i].as_buffer()) for c in ("vm", "qm"))
                score = qm.reshape(len(q), dims) @ vm.reshape(len(v), dims).T
                if not own:
                    score[q[:, None] == v[None, :]] = -2.0
                score[np.isnan(score)] = -2.0
                bar = bars.setdefault(hashlib.blake2b(qm, key=hashlib.blake2b(q).digest()).digest(), np.full(len(q), -np.inf))
                row, column, found = _best(score, bar, k, v)
                full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
                bar[full] = np.maximum(bar[full], found[np.searchsorted(row, full, side="right") - 1])
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(v[column]), pa.array(found)], ["query_id", "vec_id", "score"])

    near = left.crossJoin(right).mapInArrow(multiply, "query_id long, vec_id long, score double")
    return top(near, k, [F.col("score").desc(), "vec_id"])


def embedded(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dims: int) -> DataFrame:
    """(vec_id, embedding) of the texts (segment_id, text) by any embedder that takes a list of texts.

    Null texts are embedded as empty ones; a vector that is not of ``dims`` finite numbers is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder([t or "" for t in batch.column(1).to_pylist()])
            if not all(v is not None and len(v) == dims and np.isfinite(v).all() for v in vectors):
                raise ValueError(f"the embedder must give {dims} finite numbers for each text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return texts.select(F.col("segment_id").cast("long"), "text").mapInArrow(run, "vec_id long, embedding array<double>")


def hybrid(segments: DataFrame, queries: DataFrame, lexical: Callable[[DataFrame, DataFrame], DataFrame], vector: DataFrame, limit: int, least: float = 0.3) -> DataFrame:
    """Hits by lexical + 0.35 trigram + 0.75 vector that may be among a query's first ``limit`` by the score to six digits and the id.

    A pair is a hit if it matches lexically, is a vector candidate, or reaches ``least`` by trigrams. ``lexical`` finds
    (query_id, segment_id, lexical) for segments and queries; vector scores are not negative. Distinct texts are compared
    with distinct queries, and the first ``limit`` without vectors are spread over the copies: a vector only adds to a
    score, so any other of the first ``limit`` is a vector candidate. Trigram bounds rule out most pairs before exact
    scores are computed.
    """
    key, pair = ["query_id", "segment_id"], ["asked", "lead"]
    none = lambda c, value=0.0: F.coalesce(F.col(c), F.lit(value))
    score = lambda t: none("lexical") + VECTOR_WEIGHT * none("vector") + TRIGRAM_WEIGHT * t
    firsts, distinct = first_of_texts(segments, limit), distinct_queries(queries)
    texts = firsts.where("place = 1").select("segment_id", "text")
    bounds = trigram_bounds(texts, distinct, least).join(lexical(texts, distinct), key, "full_outer")
    listed = F.col("lexical").isNotNull()
    low, high = none("lexical") + TRIGRAM_WEIGHT * none("low"), none("lexical") + TRIGRAM_WEIGHT * none("high", least)
    plain = trigram_scores(hopeful(bounds, limit, low, high, listed | (F.col("low") >= least), SLACK).select(*key, "lexical"), texts, distinct).where(listed | (F.col("trigram") >= least))
    plain = spread(plain, firsts, queries, limit, [F.round(none("lexical") + TRIGRAM_WEIGHT * F.col("trigram"), 6).desc()])
    # vector candidates with the leads of their texts, if they have any, and the bounds of those
    asked = queries.join(distinct.withColumnRenamed("query_id", "asked"), "query").select("query_id", "asked")
    leads = segments.join(texts.withColumnRenamed("segment_id", "lead"), "text").select("segment_id", "lead")
    rows = plain.join(vector, key, "full_outer").withColumnRenamed("lexical", "found").join(asked, "query_id", "left").join(leads, "segment_id", "left")
    rows = rows.join(bounds.toDF("asked", "lead", "low", "high", "lexical"), pair, "left").withColumn("lexical", F.coalesce("found", "lexical")).drop("found")
    rows = hopeful(rows, limit, score(F.coalesce("trigram", none("low"))), score(F.coalesce("trigram", none("high", least))), slack=SLACK)
    open_pairs = rows.where("trigram IS NULL AND asked IS NOT NULL AND lead IS NOT NULL").select(F.col("asked").alias("query_id"), F.col("lead").alias("segment_id")).distinct()
    exact = trigram_scores(open_pairs, texts, distinct).toDF(*pair, "exact")
    rows = rows.join(exact, pair, "left").withColumn("trigram", F.coalesce("trigram", "exact", F.lit(0.0)))
    return rows.select(*key, none("lexical").alias("lexical"), "trigram", none("vector").alias("vector"), score(F.col("trigram")).alias("score"))


def hit_snippet(text: str, needle: str) -> Column:
    """280 characters from 80 before the first hit of the needle, or from the start without a hit."""
    return F.expr(f"substring({text}, greatest(1, locate(lower({needle}), lower({text})) - 80), 280)")


def groups(hits: DataFrame) -> DataFrame:
    """Hits (query_id, session_id, rank, segment_id) as one row per query and session, in the order of first hits."""
    rows = hits.groupBy("query_id", "session_id").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.struct("rank", "segment_id"))).alias("h"))
    return rows.select("query_id", "session_id", "first_rank", "n_hits", F.transform("h", lambda x: x["segment_id"]).alias("segments"))


def context(anchors: DataFrame, turns: DataFrame, before: int = 2, after: int = 2, most: int = 20) -> DataFrame:
    """Turns within the window around each anchor turn of the same session, with their distance."""
    before, after = min(max(before, 0), most), min(max(after, 0), most)
    rows = band_join(anchors.select("session_id", F.col("ordinal").alias("anchor")), turns, "session_id", "ordinal", "anchor", before, after)
    return rows.withColumn("distance", F.col("ordinal") - F.col("anchor"))


def valid_vector(vector: Column, dims: int) -> Column:
    """Whether a query vector has the right length and only finite parts."""
    return (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
