"""Exact removal of repeated 100-byte strings by a distributed difference-cover suffix order, cut off at that depth.

The difference-cover algorithm sorts sampled suffixes by their first characters, names them by rank, and places
every other suffix by a few characters plus the name of the sample that follows. Here only the first ``MATCH``
bytes of the order matter, so the sampled tuples are widened until one round names them and no recursion is
left: positions whose offset in their document is in a difference cover modulo ``PERIOD`` are sampled, and a
tuple is ``MATCH - PERIOD + 1`` bytes. For any two equal 100-byte strings there is a shift below the period at
which both are sampled, and both tuples lie inside the strings.

1. Documents are dealt by id range into blocks of a few MB, so that (block, offset) orders all positions.
2. Each block sorts its tuples by fingerprint, keeps the first of each name, and sends it to the name's bucket;
   a name that fills a block, or a third of the corpus, is one record a block. Buckets sort the records, name
   the tuples by their earliest position and report it back to the blocks.
3. In a block, samples that point to earlier positions at one distance merge into runs; a 100-byte string inside
   a run equals the earlier one (adjacent prefixes agree over the whole run). Strings at the edges of runs,
   where the tuple agrees and the bytes around it may not, are the remaining suffixes: they are fingerprinted
   whole and merged in buckets in the same way. The earlier side sends the strings at the edges of what others
   copy from it: it learns where those edges are from a digest of the set of its followers, which changes there.
4. Blocks mark the bytes of repeated strings and return what is left of each document.

Each step is written to the shared scratch folder. Buckets and blocks have a fixed size, so more data means more
of them. Fingerprints are 48 bits plus the bucket for tuples (a string inside a run has at least two, at one
distance) and 80 bits plus the bucket for whole strings.

Defined cases: a null text is empty; texts under 100 bytes lose nothing; repeated ids are ordered by text; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MATCH = 100
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
TUPLE = MATCH - PERIOD + 1
#: Text bytes of a block and of what a bucket receives, about.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 8 << 20
#: A place is 18 bits of partition, so many of block, and 32 of offset.
BLOCK_BITS = 13

_ODD = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base; a worker keeps the longest list it has needed."""
    if len(_POWERS.get(base, ())) < n:
        powers = np.full(max(n, BLOCK_BYTES + (1 << 18)), base, dtype=np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(powers)
    return _POWERS[base][:n]


class Rolling:
    """Polynomial fingerprints modulo 2**64 of all substrings of one block, by prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        odd = _ODD[which]
        table = np.random.default_rng(7 + which).integers(0, 2**64, 256, dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.multiply(table[data], _powers(odd, len(data)), out=self.sums[1:])
            np.cumsum(self.sums, out=self.sums)
            self.back = _powers(pow(odd, -1, 2**64), len(data) + 1)

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[at + length] - self.sums[at]) * self.back[at])


class Block:
    """A block's bytes with its sampled tuples, grouped by name."""

    def __init__(self, number: int, lengths: np.ndarray, data: np.ndarray):
        self.number, self.lengths, self.data = number, lengths, data
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.last = np.ones(len(data), dtype=bool)  # a whole string starts here
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            self.last[max(a, b - MATCH + 1) : b] = False
        long = np.flatnonzero(lengths >= MATCH)
        found = []
        for residue in COVER:
            n = (lengths[long] - TUPLE - residue) // PERIOD + 1
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(self.starts[long] + residue, n) + PERIOD * step)
        self.at = np.sort(np.concatenate(found))
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1
        self.rolling = Rolling(data)
        names = self.rolling(self.at, TUPLE)
        order = np.argsort(names, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = names[order][1:] != names[order][:-1]
        group = np.cumsum(new) - 1
        head = order[new]  # the earliest sample of each name
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = group
        by_place = np.argsort(head)
        self.head = head[by_place]
        back = np.empty(len(head), dtype=np.int64)
        back[by_place] = np.arange(len(head))
        self.group = back[self.group] if len(order) else self.group
        self.names = names[self.head]
        # a digest of the name's other samples here, by distance and document: equal along a copied passage
        own = self.head[self.group] if len(order) else self.group
        far = _mix((self.at - self.at[own]).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + self.doc.astype(np.uint64))
        followers = np.zeros(len(head), dtype=np.uint64)
        other = own != np.arange(len(own))
        with np.errstate(over="ignore"):
            np.add.at(followers, self.group[other], far[other] | _U(1))
        self.followers = followers & _U(0xFFFFFFFF)


def _planes(values: np.ndarray, kind: str) -> bytes:
    """The bytes of an array, first bytes first, so that the shuffle's compression finds the zeros."""
    values = values.astype(kind)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(raw: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T
    return np.ascontiguousarray(flat).view(kind).ravel(), at + n * size


def _encode(columns: list[tuple[np.ndarray, str]]) -> bytes:
    return len(columns[0][0]).to_bytes(4, "little") + b"".join(_planes(v, k) for v, k in columns)


def _decode(raw: bytes, kinds: list[str]) -> list[np.ndarray]:
    view, at, out = memoryview(raw), 4, []
    n = int.from_bytes(view[:4], "little")
    for k in kinds:
        values, at = _unplanes(view, at, n, k)
        out.append(values)
    return out


def _spread(key: np.ndarray, columns: list[tuple[np.ndarray, str]]) -> Iterator[tuple[int, bytes]]:
    """Records by key, each key's records encoded in their order. The first column is a rising place, sent as differences."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    columns = [(v[order], k) for v, k in columns]
    for k, a, b in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        part = [(v[a:b], kind) for v, kind in columns]
        part[0] = (np.diff(part[0][0], prepend=0), part[0][1])
        yield k, _encode(part)


SENT = "kind int, bucket int, block long, payload binary"
_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
TUPLES, STRINGS, RUNS, POINTERS, FOLLOWED, REPEATED = range(6)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 4, _SENT, strict=True)], schema=_SENT)


def blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """block, ids, lengths (bytes) and data (compressed); blocks and rows in them follow the order of the ids."""
    import zstandard

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << BLOCK_BITS
        ids, parts, size = [], [], 0

        def out() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(parts))
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in parts]], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "lengths", "data"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t = t or b""
                if ids and size + len(t) > BLOCK_BYTES:
                    yield out()
                    number += 1
                    if not number % (1 << BLOCK_BITS):
                        raise ValueError("too many blocks in one partition: raise spark.sql.shuffle.partitions")
                    ids, parts, size = [], [], 0
                ids.append(i)
                parts.append(t)
                size += len(t)
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(pack, "block long, ids array<long>, lengths array<long>, data binary")


def _read(row: dict) -> Block:
    import zstandard

    lengths = np.array(row["lengths"], dtype=np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(lengths.sum()) + 1), dtype=np.uint8)
    return Block(row["block"], lengths, data)


_TUPLE_KINDS = ["<u4", "<u8", "<u4", "<u4"]  # place, name, document, followers; the name's bytes 6 and 7 are zero


def send_tuples(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            b = _read(row)
            bucket = ((b.names >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
            columns = [(b.at[b.head], "<u4"), (b.names & _U((1 << 48) - 1), "<u8"), (b.doc[b.head], "<u4"), (b.followers, "<u4")]
            rows = [(TUPLES, k, b.number, p) for k, p in _spread(bucket, columns)]
            if rows:
                yield _table(rows).combine_chunks().to_batches()[0]


def _gather(table: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    """The bucket's records in the order of (block, place): global place, then the other columns."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
    parts = []
    for block, raw in rows:
        first, *rest = _decode(raw, kinds)
        parts.append([np.cumsum(first.astype(np.int64)) + (block << 32), *rest])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def name_tuples(table: pa.Table) -> pa.Table:
    """Name a bucket's tuples by their earliest place and tell the blocks."""
    place, name, doc, followers = _gather(table, _TUPLE_KINDS)
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = name[order][1:] != name[order][:-1]
    group = np.cumsum(new) - 1
    first = order[new][group]  # of each record in sorted order
    follows = order != first
    child, head = order[follows], first[follows]
    rows = []
    with np.errstate(over="ignore"):
        far = _mix((place[child] - place[head]).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + doc[child].astype(np.uint64)) + followers[child].astype(np.uint64)
        digest = np.zeros(len(place), dtype=np.uint64)
        np.add.at(digest, head, far | _U(1))
        led = np.unique(head)
        digest[led] += followers[led].astype(np.uint64)
    rising = np.argsort(child)
    child, head = child[rising], head[rising]
    for block, raw in _spread(place[child] >> 32, [(place[child] & 0xFFFFFFFF, "<u4"), (place[head], "<i8"), (doc[head], "<u4")]):
        rows.append((POINTERS, 0, block, raw))
    for block, raw in _spread(place[led] >> 32, [(place[led] & 0xFFFFFFFF, "<u4"), (digest[led], "<u8")]):
        rows.append((FOLLOWED, 0, block, raw))
    return _table(rows)


def _cover(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of n places lie in some interval [a, b]."""
    edge = np.zeros(n + 1, dtype=np.int32)
    some = b >= a
    np.add.at(edge, a[some], 1)
    np.add.at(edge, b[some] + 1, -1)
    return np.cumsum(edge)[:n] > 0


def merge_runs(b: Block, pointers: list[bytes], followed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place of the strings in runs, and the places of the strings that are left to compare."""
    heads = b.at[b.head]
    target, target_doc = (b.number << 32) + heads, b.doc[b.head].copy()
    digest = b.followers.copy()
    for raw in pointers:
        place, to, doc = _decode(raw, ["<u4", "<i8", "<u4"])
        g = np.searchsorted(heads, np.cumsum(place.astype(np.int64)))
        target[g], target_doc[g], digest[g] = to, doc, 0
    for raw in followed:
        place, value = _decode(raw, ["<u4", "<u8"])
        digest[np.searchsorted(heads, np.cumsum(place.astype(np.int64)))] = value
    n = len(b.data)
    to = target[b.group] if len(b.at) else np.empty(0, np.int64)
    far = (b.number << 32) + b.at - to
    points = np.flatnonzero(far != 0)
    order = points[np.lexsort((b.at[points], target_doc[b.group[points]] if len(points) else points, far[points], b.doc[points]))]
    at, doc, distance, other = b.at[order], b.doc[order], far[order], target_doc[b.group[order]] if len(order) else order
    cut = np.ones(len(order), dtype=bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (distance[1:] != distance[:-1]) | (other[1:] != other[:-1]) | (np.diff(at) > TUPLE)
    opens = np.flatnonzero(cut)
    closes = np.append(opens[1:] - 1, len(order) - 1) if len(opens) else opens
    first, last = at[opens], at[closes] + TUPLE - MATCH
    runs = last >= first
    first, last = first[runs], last[runs]
    known = _cover(n, first, last)
    start = b.starts[b.doc]
    reach = PERIOD - 1
    edge = _cover(n, np.maximum(b.at[points] - reach, start[points]), b.at[points])
    # the earlier side: around samples whose followers are not those of the sample one period before or after
    index = np.full(n + 2 * PERIOD, -1, dtype=np.int32)
    index[b.at + PERIOD] = np.arange(len(b.at))
    value = np.zeros(len(b.at) + 1, dtype=np.uint64)
    lead = b.head[(target == (b.number << 32) + heads) & (digest != 0)]
    value[lead] = digest[b.group[lead]] if len(lead) else 0
    for step in (-PERIOD, PERIOD):
        near = index[b.at[lead] + PERIOD + step]
        same = (near >= 0) & (value[near] == value[lead]) & (b.doc[near] == b.doc[lead])
        c = lead[~same]
        low, high = (b.at[c] - reach, b.at[c] - 1) if step < 0 else (b.at[c] - reach + 1, b.at[c])
        edge |= _cover(n, np.maximum(low, start[c]), high)
    return first, last, np.flatnonzero(edge & ~known & b.last)


def send_strings(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """A block's runs, and the fingerprints of the strings that are left, for their buckets."""
    rows: list[tuple] = []
    for row in left.to_pylist():
        b = _read(row)
        said = list(zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True))
        first, last, rest = merge_runs(b, [p for k, p in said if k == POINTERS], [p for k, p in said if k == FOLLOWED])
        if len(first):
            rows.append((RUNS, 0, b.number, _encode([(first, "<u4"), (last, "<u4")])))
        if len(rest):
            one, two = b.rolling(rest, MATCH), Rolling(b.data, 1)(rest, MATCH)
            bucket = ((two >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
            rows += [(STRINGS, k, b.number, p) for k, p in _spread(bucket, [(rest, "<u4"), (one, "<u8"), (two & _U(0xFFFF), "<u2")])]
    return _table(rows)


def match_strings(table: pa.Table) -> pa.Table:
    """The strings of a bucket that also start earlier, by block."""
    place, one, two = _gather(table, ["<u4", "<u8", "<u2"])
    order = np.lexsort((place, two, one))
    later = np.zeros(len(order), dtype=bool)
    later[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    found = np.sort(place[order[later]])
    return _table([(REPEATED, 0, block, raw) for block, raw in _spread(found >> 32, [(found & 0xFFFFFFFF, "<u4")])])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove(left: pa.Table, right: pa.Table, texts: bool) -> pa.Table:
    """What is left of a block's documents."""
    import zstandard

    out: list[tuple] = []
    for row in left.to_pylist():
        lengths = np.array(row["lengths"], dtype=np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(lengths.sum()) + 1)
        data, n = np.frombuffer(raw, dtype=np.uint8), int(lengths.sum())
        edge = np.zeros(n + 1, dtype=np.int32)
        for kind, payload in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True):
            if kind == RUNS:
                first, last = (x.astype(np.int64) for x in _decode(payload, ["<u4", "<u4"]))
            elif kind == REPEATED:
                first = last = np.cumsum(_decode(payload, ["<u4"])[0].astype(np.int64))
            else:
                continue
            np.add.at(edge, first, 1)
            np.add.at(edge, last + MATCH, -1)
        gone = np.cumsum(edge)[:n] > 0
        end = 0
        for i, length in zip(row["ids"], lengths.tolist(), strict=True):
            start, end = end, end + length
            mask = gone[start:end]
            removed = int(mask.sum())
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0]) if removed else 0
            kept = data[start:end][~mask].tobytes() if removed else raw[start:end]
            out.append((i, length, removed, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 6, _RESULT, strict=True)], schema=_RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """The contract's columns; with ``texts`` also ``kept``, the remaining bytes."""
    table = materialize(blocks(docs, id_col, text), "blocks")
    size = table.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    buckets = max(16, min(1 << 24, 2 * size // BUCKET_BYTES))  # 24 bits of the name: buckets keep their size up to 67 TB of text
    tuples = table.mapInArrow(lambda it: send_tuples(it, buckets), SENT)
    named = materialize(tuples.groupBy("bucket").applyInArrow(name_tuples, SENT), "names")
    strings = table.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(lambda a, b: send_strings(a, b, buckets), SENT)
    strings = materialize(strings, "strings")
    repeated = strings.where(F.col("kind") == STRINGS).groupBy("bucket").applyInArrow(match_strings, SENT)
    marks = strings.where(F.col("kind") == RUNS).unionByName(repeated)
    result = table.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda a, b: remove(a, b, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if texts else result.drop("kept")
