"""Lexical search of blocks: the first segments of each query whose clauses of words and phrases match, by their covers.

1. Segments are dealt into blocks of about ``BLOCK`` bytes of text by a hash of their id. Every block meets all queries.
2. A block's terms are one flat array; a term's postings are the places where it stands, in order. A clause begins at its
   rarest item, and the others are looked up only inside the segments that are left. A phrase is its rarest word's
   postings with its other words beside them.
3. An analyzer that works word by word (``analysis.Words``) is asked once for each distinct word; a block is sent the terms
   of its words.
4. Covers, the shortest stretches that hold all items, come from running maxima of the items' starts.

A block gives no more than ``limit`` rows a query, so neither postings nor pairs are shuffled: the segments are once, the
queries once a block. A task holds a block, and the packed queries. Terms are not empty and hold no ``BETWEEN``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Words

#: Stands between terms on their way.
BETWEEN = "\x1f"
#: Bytes of text of a block, and queries that are packed together.
BLOCK, PACK = 8 << 20, 1024
#: The items of a query: ``k`` is how many of a clause must occur, those with a ``slot``; null terms are gaps.
ITEMS = "array<struct<clause:int,slot:int,negative:boolean,terms:array<string>,k:int>>"
#: Starts and lengths of a clause's covers by segment (in order, each at least once) to a rank of each segment.
Rank = Callable[[np.ndarray, np.ndarray, int], np.ndarray]

_EMPTY, _GAP, _ABSENT = np.zeros(0, dtype=np.int64), -1, -2


def summed(cover: int, digits: int) -> Rank:
    """The sum over the covers, 1 for one of up to ``cover`` terms, ``cover`` by length beyond that."""

    def rank(segment: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(segment, weights=float(cover) / np.maximum(cover, length), minlength=n)
        return np.floor(total * 10.0**digits + 0.5) / 10.0**digits

    return rank


def shortest(segment: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """1 / (length of the shortest cover)."""
    return 1.0 / np.minimum.reduceat(length, np.searchsorted(segment, np.arange(n)))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys of an ordered array."""
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Block:
    """Segments by number, in the order of their ids; with ``merged``, rows of one id are one segment.

    ``texts``: terms joined by ``BETWEEN``, empty ones are gaps. ``terms_of``: words and their terms, if the texts are of words.
    """

    def __init__(self, ids: np.ndarray, texts: pa.Array, merged: bool, terms_of: tuple[pa.Array, pa.Array] | None = None):
        order = np.argsort(ids, kind="stable")
        ids, terms = ids[order], pc.split_pattern(texts.take(pa.array(order)), BETWEEN)
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        del terms, coded
        told = pc.if_else(pc.equal(self.words, ""), pa.scalar(None, self.words.type), self.words) if terms_of is None else terms_of[1].take(pc.index_in(self.words, value_set=terms_of[0]))
        told = told.dictionary_encode()
        self.words, number = told.dictionary, told.indices.fill_null(_GAP).to_numpy(zero_copy_only=False).astype(np.int32)
        self.codes = number[self.codes]
        self.upto = np.concatenate([[0], np.cumsum(sizes)])
        self.row_of = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)]) if merged else np.arange(len(ids))
        self.ids, self.cuts = ids[first], np.append(self.upto[first], self.upto[-1])
        self.segment_of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(self.cuts))
        self.places = np.argsort(self.codes, kind="stable")
        self.posted = np.cumsum(np.bincount(self.codes + 1, minlength=len(self.words) + 1))

    def often(self, item: tuple[np.ndarray, np.ndarray]) -> int:
        """The number of postings of the item's rarest term."""
        codes = item[1]
        return int((self.posted[codes + 1] - self.posted[codes]).min()) if len(codes) and codes.min() >= 0 else 0

    def spots(self, item: tuple[np.ndarray, np.ndarray], segments: np.ndarray | None) -> np.ndarray:
        """Places where the item (offsets, codes) starts, in order, of the given segments or of all."""
        offsets, codes = item
        if not self.often(item):
            return _EMPTY
        j = int((self.posted[codes + 1] - self.posted[codes]).argmin())
        at = self.places[self.posted[codes[j]] : self.posted[codes[j] + 1]]
        if segments is not None:
            low, high = np.searchsorted(at, self.cuts[segments]), np.searchsorted(at, self.cuts[segments + 1])
            n = high - low
            at = at[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if len(codes) == 1:
            return at
        row, start = self.row_of[at], at - offsets[j]
        start = start[(start >= self.upto[row]) & (start + offsets[-1] < self.upto[row + 1])]
        for offset, code in zip(offsets, codes, strict=True):
            start = start[self.codes[start + offset] == code]
        return start

    def clause(self, wanted: list, unwanted: list, rank: Rank) -> tuple[np.ndarray, np.ndarray]:
        """The segments that hold all wanted items and none of the others, and their ranks."""
        segments, found = None, []
        for item in sorted(wanted, key=self.often):
            at = self.spots(item, segments)
            segments = _distinct(self.segment_of[at])
            if not len(segments):
                return _EMPTY, _EMPTY
            found.append((at, int(item[0][-1])))
        for item in unwanted:
            segments = segments[~np.isin(segments, self.segment_of[self.spots(item, segments)])]
        if not len(segments):
            return _EMPTY, _EMPTY
        parts = []
        for slot, (at, reach) in enumerate(found):
            of = self.segment_of[at]
            number = np.minimum(np.searchsorted(segments, of), len(segments) - 1)
            kept = segments[number] == of
            start = at[kept] - self.upto[self.row_of[at[kept]]]
            parts.append((number[kept], start + reach, start, np.full(len(start), slot)))
        return segments, rank(*_covers(*map(np.concatenate, zip(*parts, strict=True)), len(found)), len(segments))


def _covers(segment: np.ndarray, stop: np.ndarray, start: np.ndarray, slot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, length) of the covers of ``k`` items by their spots, in the order of segments and ends.

    At each end, the items' latest starts so far are known; a later least of them than before begins a cover.
    """
    order = np.lexsort((stop, segment))
    segment, stop, start, slot = segment[order], stop[order], start[order], slot[order]
    base = segment * (int(start.max()) + 2)  # values of a segment exceed those of the segments before it
    least = None
    for i in range(k):
        latest = np.maximum.accumulate(base + np.where(slot == i, start + 1, 0)) - base
        least = latest if least is None else np.minimum(least, latest)
    last = np.append((segment[1:] != segment[:-1]) | (stop[1:] != stop[:-1]), True)
    segment, stop, least = segment[last], stop[last], least[last]
    before = np.concatenate([[0], np.where(segment[1:] == segment[:-1], least[:-1], 0)])
    new = least > before
    return segment[new], stop[new] - least[new] + 2


def _best(block: Block, queries: pa.Table, limit: int, rank: Rank) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query_id, segment ids, ranks) of the first ``limit`` segments of each query by rank and id."""
    listed = queries.column("items").combine_chunks()
    items, terms = listed.flatten(), listed.flatten().field("terms")
    clause, slot, negative, k = (items.field(c).fill_null(-1 if c != "negative" else False).to_numpy(zero_copy_only=False) for c in ("clause", "slot", "negative", "k"))
    flat = terms.flatten()
    codes = pc.index_in(flat, value_set=block.words).fill_null(_ABSENT).to_numpy(zero_copy_only=False).astype(np.int64)
    codes[flat.is_null().to_numpy(zero_copy_only=False)] = _GAP
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).fill_null(0).to_numpy(zero_copy_only=False))]).tolist()

    def item(i: int) -> tuple[np.ndarray, np.ndarray]:
        some = codes[bounds[i] : bounds[i + 1]]
        offsets = np.flatnonzero(some != _GAP)
        return offsets, some[offsets]

    for number, query_id in enumerate(queries.column("query_id").to_pylist()):
        clauses: dict[int, list[int]] = {}
        for i in range(ends[number], ends[number + 1]):
            clauses.setdefault(int(clause[i]), []).append(i)
        found = []
        for parts in clauses.values():
            wanted = [i for i in parts if not negative[i]]
            if wanted and len({int(slot[i]) for i in wanted}) == int(k[wanted[0]]):
                wanted = [item(i) for i in wanted]
                if all(block.often(x) for x in wanted):
                    found.append(block.clause(wanted, [item(i) for i in parts if negative[i]], rank))
        found = [x for x in found if len(x[0])]
        if found:
            segments, ranks = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(found) > 1:  # the best clause of a segment counts
                order = np.lexsort((-ranks, segments))
                order = order[np.append(True, segments[order][1:] != segments[order][:-1])]
                segments, ranks = segments[order], ranks[order]
            order = np.lexsort((segments, -ranks))[:limit]  # segments are numbered in the order of ids
            yield query_id, block.ids[segments[order]], ranks[order]


FOUND = pa.schema([("query_id", pa.int64()), ("segment_id", pa.int64()), ("lexical", pa.float64())])


def first_matches(segments: DataFrame, queries: DataFrame, analyze: Callable[[Column], Column], limit: int, rank: Rank, merged: bool = True) -> DataFrame:
    """(query_id, segment_id, lexical): rows that hold each query's first ``limit`` segments by ``rank`` and id.

    ``segments``: segment_id, text; ``queries``: query_id, items (:data:`ITEMS`). A query's rank of a segment is that of its
    best clause. Segments of one id count as one text whose places are those of all, or without ``merged`` as many; queries
    of one id are many.
    """
    total = segments.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    by_word = isinstance(analyze, Words)
    split = (analyze.split if by_word else analyze)(F.col("text"))
    number = F.pmod(F.xxhash64("segment_id"), F.lit(n)).alias("block")
    dealt = segments.select(number, F.col("segment_id").cast("long"), F.array_join(split, BETWEEN, "").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(at, PACK))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], ["pack"])

    packs = queries.select(F.col("query_id").cast("long"), F.col("items").cast(ITEMS)).mapInArrow(pack, "pack binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    told = packs.select(every.alias("of"), "pack", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("term"))
    if by_word:
        words = segments.select(number, F.explode(F.array_distinct(split)).alias("word")).distinct()
        # a word is little data and much work: by bytes, all words could be one task
        once = words.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word").groupBy("word").agg(F.collect_list("block").alias("blocks"))
        once = once.select("word", analyze.term(F.col("word")).alias("term"), "blocks")
        told = told.union(once.select(F.explode("blocks").alias("of"), F.lit(None).cast("binary").alias("pack"), "word", "term"))

    def run(here: pa.Table, told: pa.Table) -> pa.Table:
        packed = told.column("pack").drop_null()
        if not here.num_rows or not len(packed):
            return FOUND.empty_table()
        words = told.filter(pc.is_valid(told.column("word")))
        terms_of = (words.column("word").combine_chunks(), words.column("term").combine_chunks()) if by_word else None
        block = Block(here.column("segment_id").to_numpy(), here.column("text").combine_chunks(), merged, terms_of)
        found = [x for pack in packed for x in _best(block, pa.ipc.open_stream(pack.as_buffer()).read_all(), limit, rank)]
        sizes = [len(ids) for _, ids, _ in found]
        columns = np.repeat(np.array([q for q, _, _ in found], dtype=np.int64), sizes), np.concatenate([_EMPTY, *(x for _, x, _ in found)]), np.concatenate([_EMPTY, *(x for _, _, x in found)])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    return dealt.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, "query_id long, segment_id long, lexical double")
