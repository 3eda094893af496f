"""Alignment of two tokenizers' tokens over the same bytes by interval coalescing.

1. A block of documents (``BLOCK`` bytes of text) is cut into units: a blank or a line feed between two printable
   characters begins a new unit, since neither tokenizer has a token across it. Distinct units are tokenised once.
2. Tokens of both sides are intervals of bytes. They are sorted by start with ``lexsort``; a running maximum of the ends
   (``maximum.accumulate``) breaks them into groups where a start reaches it. Inside a group all A tokens are linked to
   all B tokens; repeated ids of a group are counted before the product is made.
3. A block is written with its units, their id pairs and how many of its documents hold each pair. The pairs' counts are
   summed over the blocks by a shuffle, the highest of each A id is found, and both are joined back to the blocks that
   asked. Links add up over units, so a document's sums are those of its units.

So neither a document's pairs nor the table of pairs is ever in one task; a task holds a block.

Defined cases: a null or empty text, or one that a tokenizer does not give back byte by byte, has no tokens, zeros and
empty groups; repeated rows are documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, worker_cache
from .packing import gather

#: Bytes of text that a task works on at once.
BLOCK = 4 << 20
#: Bytes of distinct units that are tokenised in one call, and pairs that are made distinct at once.
CALL, PAIRS = 1 << 16, 1 << 19
SHIFT = 1 << 32


def byte_level() -> dict[str, int]:
    """The published byte alphabet of byte-level tokenizers: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, entries: list[bytes], encode):
        self.encode = encode
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.size, ids)[0]


def byte_side(path: str) -> Side:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = byte_level()
    added = {t["id"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    entries = [n.encode() if i in added else bytes(letters[c] for c in n) for i, n in enumerate(names)]
    return Side(entries, lambda text: tokenizer.encode(text, add_special_tokens=False).ids)


def piece_side(path: str) -> Side:
    """``encode`` takes the text with the blank that the tokenizer would put in front. A text that begins with a line feed
    is encoded with that blank as a piece of its own, which is taken off."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    entries = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    blank = model.piece_to_id("▁")

    def encode(text: str) -> list[int]:
        if text[:1] == " ":
            return model.encode(text[1:], num_threads=1)
        ids = model.encode(text, num_threads=1)
        return ids[1:] if ids[:1] == [blank] else []

    return Side(entries, encode)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sides(paths: tuple[str, str]) -> tuple[Side, Side]:
    """The worker's own tokenizers."""
    cache = worker_cache("alignment")
    if paths not in cache:
        cache[paths] = byte_side(paths[0]), piece_side(paths[1])
    return cache[paths]


def printable(data: np.ndarray) -> np.ndarray:
    """For each byte whether its character surely is no white space and no word-start mark: ASCII signs and letters, and
    characters of ranges that hold none (U+00C0 to U+07FF, from U+4000 on)."""
    lead = ((data > 0x20) & (data < 0x7F)) | ((data >= 0xC3) & (data <= 0xDF)) | ((data >= 0xE4) & (data <= 0xF4))
    tail = (data & 0xC0) == 0x80
    for _ in range(3):
        lead[1:] |= tail[1:] & lead[:-1]
    return lead


def cut_units(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of documents that begin at ``starts``."""
    fine = printable(data)
    at = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1
    at = at[fine[at - 1] & fine[at + 1]]
    return distinct(np.concatenate([at, starts]))


def _encode(side_a: Side, side_b: Side, raw: bytes, ends: np.ndarray):
    """(ids, ids) of some units in one call, or None unless both sides give the bytes back and end where units end."""
    text = raw.decode()
    data = np.frombuffer(raw, dtype=np.uint8)
    out = []
    for side in (side_a, side_b):
        ids = np.array(side.encode(text), dtype=np.int64)
        if not np.array_equal(side.text(ids), data):
            return None
        upto = np.cumsum(side.size[ids])
        cuts = np.searchsorted(upto, ends)
        if not np.array_equal(upto[cuts], ends):
            return None
        out.append((ids, np.diff(np.concatenate([[0], cuts + 1]))))
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in order, by sorting: faster than hashing at these sizes."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def safe_units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which units may stand beside each other in one call: a blank or line feed, then characters that are printable at both
    ends. Very long ones are left alone."""
    sizes = np.diff(offsets)
    if not len(data):
        return np.zeros(len(sizes), dtype=bool)
    shown, first = printable(data), np.minimum(offsets[:-1], len(data) - 1)
    begins = (data[first] == 0x20) | (data[first] == 0x0A)
    return (sizes > 1) & (sizes <= 1024) & begins & shown[np.minimum(first + 1, len(data) - 1)] & shown[offsets[1:] - 1]


def tokenize_units(data: np.ndarray, offsets: np.ndarray, side_a: Side, side_b: Side):
    """Both sides' ids of distinct units behind each other, their number in each unit, and which units come back whole.
    Safe units go many to a call; where those don't come back whole, and for all others, each is a call of its own."""
    n_units = len(offsets) - 1
    parts: list = [([], []), ([], [])]
    fine = np.ones(n_units, dtype=bool)

    def call(first: int, last: int) -> None:
        raw = data[offsets[first] : offsets[last]].tobytes()
        got = _encode(side_a, side_b, raw, offsets[first + 1 : last + 1] - offsets[first])
        if got is None and last - first > 1:
            for k in range(first, last):
                call(k, k + 1)
            return
        fine[first:last] = got is not None
        for (ids, n), found in zip(parts, got or [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2, strict=True):
            ids.append(found[0])
            n.append(found[1])

    at, odd = 0, [*np.flatnonzero(~safe_units(data, offsets)).tolist(), n_units]
    for stop in odd:
        while at < stop:
            end = min(stop, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CALL))))
            call(at, end)
            at = end
        if stop < n_units:
            call(stop, stop + 1)
            at = stop + 1
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return [(flat(ids), flat(n)) for ids, n in parts], fine


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start, and the group of each in that order: a group ends where a start reaches the greatest end so far."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order]) if len(order) else ends
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) with their counts, by group."""
    every = np.sort(group.astype(np.int64) * SHIFT + ids)
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    keys = every[first]
    return keys // SHIFT, keys % SHIFT, np.diff(np.append(first, len(every)))


class Units:
    """Groups, links and texts of distinct units. Arrays by unit: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``texts``;
    arrays by id pair of a unit: ``pair`` (A id times 2^32 plus B id), ``weight``, with ``upto`` by unit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, side_a: Side, side_b: Side):
        (a, b), self.fine = tokenize_units(data, offsets, side_a, side_b)
        n_units = len(offsets) - 1
        self.n_a, self.n_b = a[1], b[1]
        ids = np.concatenate([a[0], b[0]]).astype(np.int32)
        side = np.repeat(np.array([0, 1], dtype=np.int8), [len(a[0]), len(b[0])])
        unit = np.concatenate([np.repeat(np.arange(n_units, dtype=np.int32), x[1]) for x in (a, b)])
        size = np.concatenate([side_a.size[a[0]], side_b.size[b[0]]])
        ends = np.concatenate([np.cumsum(size[side == 0]), np.cumsum(size[side == 1])])
        order, group = coalesce(ends - size, ends, side)
        del size, ends, a, b
        ids, side, unit, group = ids[order], side[order], unit[order], group.astype(np.int32)
        del order
        total = int(group[-1]) + 1 if len(group) else 0
        of = np.zeros(total, dtype=np.int32)
        of[group] = unit  # tokens of a group lie in one unit
        self.n_groups = np.bincount(of, minlength=n_units)
        self.texts = self._texts(ids, side, unit, group, n_units)
        # links: distinct ids of both sides of a group meet
        in_a, in_b = (np.bincount(group[side == k], minlength=total) for k in (0, 1))
        self.n_links = np.bincount(of, weights=in_a * in_b, minlength=n_units).astype(np.int64)
        group_a, id_a, count_a = _counted(group[side == 0], ids[side == 0])
        group_b, id_b, count_b = _counted(group[side == 1], ids[side == 1])
        there = np.bincount(group_b, minlength=total)
        first = np.cumsum(there) - there
        times = there[group_a]
        left = np.repeat(np.arange(len(group_a), dtype=np.int32), times)
        right = np.repeat(first[group_a] - np.cumsum(times) + times, times) + np.arange(times.sum())
        self.pair, self.weight = id_a[left] * SHIFT + id_b[right], count_a[left] * count_b[right]
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(of[group_a[left]], minlength=n_units))])

    @staticmethod
    def _texts(ids: np.ndarray, side: np.ndarray, unit: np.ndarray, group: np.ndarray, n_units: int) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each unit: tokens by group and side, each with the sign that follows it."""
        by = np.argsort(group.astype(np.int64) * 2 + side, kind="stable")
        ids, side, unit, group = ids[by], side[by], unit[by], group[by]
        sign = np.full(len(by), 3, dtype=np.int32)
        same_side, same_unit = side[1:] == side[:-1], unit[1:] == unit[:-1]
        sign[:-1] = np.where(group[1:] == group[:-1], np.where(same_side, 0, 1), np.where(same_unit, 2, 3))
        used = distinct(ids)  # only ids of this block are written out
        names = [str(i).encode() + s for i in used.tolist() for s in (b",", b"|", b";", b"")]
        sizes = np.array([len(n) for n in names], dtype=np.int64)
        data, upto = gather(np.frombuffer(b"".join(names), dtype=np.uint8), sizes, np.searchsorted(used, ids) * 4 + sign)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=n_units))])
        return pa.Array.from_buffers(pa.large_binary(), n_units, [None, pa.py_buffer(upto[cuts].astype(np.int64)), pa.py_buffer(data)])


def _documents_of_pairs(doc: np.ndarray, code: np.ndarray, units: Units, pair: np.ndarray, n_pairs: int) -> np.ndarray:
    """How many documents hold each pair. ``pair``: numbers of the units' pairs."""
    n_units = len(units.n_a)
    keys = distinct(doc * n_units + code)  # a unit counts once in a document
    doc, code = keys // n_units, keys % n_units
    del keys
    sizes = np.diff(units.upto)[code]
    found, at, upto = np.zeros(n_pairs, dtype=np.int64), 0, np.cumsum(sizes)
    ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1  # whole documents at a time
    while at < len(doc):
        base = upto[at - 1] if at else 0
        k = max(np.searchsorted(upto[ends - 1], base + PAIRS, side="right") - 1, np.searchsorted(ends, at, side="right"))
        last = ends[k]
        numbers, _ = gather(pair, np.diff(units.upto), code[at:last])
        held = distinct(np.repeat(doc[at:last], sizes[at:last]) * n_pairs + numbers)
        found += np.bincount(held % n_pairs, minlength=n_pairs)
        at = last
    return found


def narrow(values: np.ndarray) -> str:
    """The smallest unsigned type that holds the values."""
    return f"<u{np.min_scalar_type(int(values.max(initial=0))).itemsize}"


#: A block: documents with what they need no other block for, their units, the units' pairs by number, and the pairs.
BLOCKS = "block long, docs array<long>, sums binary, groups array<string>, units binary, cuts binary, upto binary, pair_of binary, weight binary, pairs array<long>, holders array<long>"


def _block(number: int, doc_ids: pa.Array, texts: pa.Array, side_a: Side, side_b: Side) -> dict:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.take(pa.array(some)), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset : spaced.offset + len(spaced) + 1] if len(some) else np.zeros(1, np.int64)
    data = np.frombuffer(spaced.buffers()[2], dtype=np.uint8)[: offsets[-1]] if len(some) else np.zeros(0, np.uint8)
    starts = cut_units(data, offsets[:-1]) if len(data) > 2 else offsets[:-1]
    spots = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    coded = spots.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    bounds = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    units = Units(np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[: bounds[-1]], bounds, side_a, side_b)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    whole = np.ones(len(some), dtype=bool)
    whole[doc[~units.fine[code]]] = False
    keep = whole[doc]
    doc, code = doc[keep], code[keep]
    sums = np.zeros((4, len(doc_ids)), dtype=np.int64)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(some[doc], minlength=len(doc_ids)))])
    for k, values in enumerate((units.n_a, units.n_b, units.n_groups, units.n_links)):
        sums[k] = np.diff(np.concatenate([[0], np.cumsum(values[code])])[cuts])
    groups = [""] * len(doc_ids)
    for i in np.flatnonzero(np.diff(cuts)):
        digest = hashlib.sha256()
        for at in range(cuts[i], cuts[i + 1], 1 << 16):
            here = units.texts.take(pa.array(code[at : min(at + (1 << 16), cuts[i + 1])]))
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(here)], here), pa.scalar(b";", pa.large_binary()))
            digest.update((b";" if at > cuts[i] else b"") + joined[0].as_py())
        groups[i] = digest.hexdigest()
    pairs = distinct(units.pair)
    pair_of = np.searchsorted(pairs, units.pair)
    holders = _documents_of_pairs(some[doc], code, units, pair_of, len(pairs)) if len(code) else np.zeros(len(pairs), np.int64)
    raw = lambda x, kind: np.ascontiguousarray(x, dtype=kind).tobytes()
    return {"block": number, "docs": doc_ids.to_pylist(), "sums": raw(sums, "<i8"), "groups": groups, "units": raw(code, "<i4"), "cuts": raw(cuts, "<i8"), "upto": raw(units.upto, "<i8"), "pair_of": raw(pair_of, "<i4"), "weight": raw(units.weight, narrow(units.weight)), "pairs": pairs, "holders": holders}


def text_blocks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) with about ``most`` bytes of text each; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield at, end - at
        at = end


def align(docs: DataFrame, paths: tuple[str, str] | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, pairs): the written blocks, and (pair, n) how many documents hold each pair of an A and a B id, linked."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(paths)
        number = TaskContext.get().partitionId() << 32
        kinds = {"docs": pa.list_(pa.int64()), "groups": pa.list_(pa.string()), "pairs": pa.list_(pa.int64()), "holders": pa.list_(pa.int64()), "block": pa.int64()}
        for batch in batches:
            for at, n in text_blocks(batch.column(1), block):
                row = _block(number, batch.column(0).slice(at, n), batch.column(1).slice(at, n), side_a, side_b)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))
                give_back()

    # a row group for each block: readers load row groups whole, however many blocks a file has
    blocks = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS), "aligned", {"parquet.block.row.count.limit": 1})
    asked = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    return blocks, asked.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_table(pairs: DataFrame) -> DataFrame:
    """a_id, b_id, n and whether no other B id is held with that A id by more documents."""
    rows = pairs.where("n > 0").select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(SHIFT - 1).alias("b_id"), "pair", "n")
    return rows.join(rows.groupBy("a_id").agg(F.max("n").alias("most")), "a_id").select("a_id", "b_id", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


REPORT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def _report(row: dict, told: pa.Table) -> pa.Table:
    """The documents of a block. ``told``: at most one row with ``n`` and ``best`` of the block's pairs."""
    units, cuts, upto, pair_of = np.frombuffer(row["units"], "<i4"), np.frombuffer(row["cuts"], "<i8"), np.frombuffer(row["upto"], "<i8"), np.frombuffer(row["pair_of"], "<i4")
    weight = np.frombuffer(row["weight"], f"<u{len(row['weight']) // max(1, len(pair_of))}" if len(pair_of) else "u1").astype(np.int64)
    n, best = (told.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("n", "best"))
    sums = [*np.frombuffer(row["sums"], "<i8").reshape(4, -1)]
    for value in (best.astype(bool)[pair_of] * weight, n.astype(np.int64)[pair_of] * weight):  # by pair of a unit, then by unit, then by document
        by_unit = np.diff(np.concatenate([[0], np.cumsum(value)])[upto])
        sums.append(np.diff(np.concatenate([[0], np.cumsum(by_unit[units])])[cuts]))
    return pa.Table.from_arrays([pa.array(row["docs"], pa.int64()), *map(pa.array, sums), pa.array(row["groups"], pa.string())], schema=REPORT)


def alignment_report(docs: DataFrame, paths: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """The contract's columns, one row per document."""
    blocks, pairs = align(docs, paths, block)
    table = materialize(pair_table(pairs).select("pair", "n", "best"), "pair_counts")
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(table, "pair", "left").select("block", F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(False)).alias("best")).alias("t"))
    told = told.groupBy("block").agg(F.array_sort(F.collect_list("t")).alias("t")).select(F.col("block").alias("of"), F.col("t.n").alias("n"), F.col("t.best").alias("best"))

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        parts = [_report(block.slice(i, 1).to_pylist()[0], told) for i in range(block.num_rows)]
        return pa.concat_tables(parts) if parts else REPORT.empty_table()

    # blocks meet their counts group by group: a worker is sent one block at a time, however many share a task
    return blocks.drop("pairs", "holders").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
