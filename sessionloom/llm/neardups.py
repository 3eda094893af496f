"""Near-duplicate documents by BagMinHash signatures of word shingles.

A document is the multiset of its five-word shingles. Its signature has ``BANDS * ROWS`` components, each the
least point of a Poisson process over the (shingle, weight) plane below the multiset's counts, so that two
documents agree in a component with probability equal to their weighted Jaccard similarity
sum(min) / sum(max). The processes are hierarchical over the discretised weights: each dyadic block of a shingle's
weight axis has one, so work grows with the logarithm of a count, and points beyond the largest component so far are
not generated, which for a long document is after the first point of nearly all processes.

Texts that are equal share one representative from the start, found by a combined aggregate; only representatives
are signed and compared. Signatures are banded; in each bucket every member is
tried with two pivots, the member with most neighbours over all buckets and a random one; what they link is
contracted to components. Last, members outside a bucket's largest component are tried with the bucket's members of
other components, where a bound allows it: shingles that no other component has cannot be shared, so the overlap is
at most the lesser weight of the rest. A pair is made in its first common band only, and if enough signature bytes agree.
So the pairs of a large group of half-alike texts are not made. Tries are verified on whole multisets: the links
between different texts that a bucket holds are verified, implied or excluded. Components come from star contraction.

Defined cases: a null text or one of white space alone (blank, tab, line ends) has no shingles and links with nothing, texts under five words are one shingle
of all their words; equal texts are one class (null and empty texts are classes of one); repeated rows share a
class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, worker_cache
from .graph import components
from .secrets import text_buffers

WORDS, SIMILARITY = 5, 0.8
#: 26 bands of 5: a pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**26 > 0.9999.
BANDS, ROWS = 26, 5
#: A longer signature for texts that are left to compare across components: its components, and how many must agree. At
#: similarity 0.8 it is 403 with a deviation of 9, so a pair is lost here with probability below 1e-5.
COMPARED, AGREEING = 504, 361

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts in a UTF-8 buffer, and the number of the text of each."""
    space = np.ones(len(data) + 1, dtype=bool)
    space[:-1] = _SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True  # texts do not run into each other
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-2]
    starts = np.flatnonzero(~space[:-1] & (before | cut[:-1]))
    ends = np.flatnonzero(~space[:-1] & (space[1:] | cut[1:])) + 1
    with np.errstate(over="ignore"):
        powers = np.full(len(data) + 1, _ODD, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * powers[:-1], out=sums[1:])
        back = np.full(len(data) + 1, pow(_ODD, -1, 2**64), dtype=np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        word = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        n = np.bincount(doc, minlength=len(offsets) - 1)
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(len(word)) - first[doc]
        whole = np.minimum(n, WORDS)[doc]  # words of a shingle in this text
        opens = np.flatnonzero(place + whole <= n[doc])
        h = np.zeros(len(opens), dtype=np.uint64)
        for k in range(WORDS):
            inside = k < whole[opens]
            nxt = word[np.minimum(opens + k, len(word) - 1)] if len(word) else h
            h = np.where(inside, mix(h * _U(_ODD) + nxt + _U(k + 1)), h)
    return h, doc[opens]


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle."""
    h, doc = shingles(data, offsets)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(key: np.ndarray, point: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(key + _U((3 * point + salt) * 0x9E3779B97F4A7C15 % 2**64)) >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: [text, component] keys of the least points. Texts without shingles keep zeros.

    The weight axis of a shingle is cut into the dyadic blocks [0, 1), [1, 2), [2, 4), [4, 8) and so on. A block has a Poisson
    process of its own, of rate ``size`` times its width, so a count of c takes 1 + log2(c) processes; points rise by
    exponential steps, a point's place in the block and its component are drawn from its hash, and points at or above
    the count are not the text's. A process ends at the first point beyond the largest component.
    """
    blocks = np.frexp(count.astype(np.float64))[1]
    reps = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(reps)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 2.0 ** (block - 1), 0.0)
    width = np.maximum(low, 1.0)
    total = np.bincount(doc, weights=count, minlength=n)
    doc, most = doc[reps], count[reps]
    with np.errstate(over="ignore"):
        key = mix(shingle[reps] + mix(block.astype(np.uint64) + _U(1)))
    least = np.full((n, size), np.inf)
    sign = np.zeros((n, size), dtype=np.uint64)
    todo = total > 0
    limit = (np.log(size) + 3.0) / np.maximum(total, 1)
    while todo.any():
        some = np.flatnonzero(todo[doc])
        at = np.zeros(len(some))
        point = 0
        while len(some):
            at = at - np.log(_uniform(key[some], point, 0)) / (size * width[some])
            live = at < limit[doc[some]]
            at, some = at[live], some[live]
            inside = low[some] + np.floor(_uniform(key[some], point, 2) * width[some]) < most[some]
            t, k, d = at[inside], key[some[inside]], doc[some[inside]]
            slot = np.minimum((_uniform(k, point, 1) * size).astype(np.int64), size - 1)
            order = np.lexsort((k, t, slot, d))
            top = np.ones(len(order), dtype=bool)
            top[1:] = (d[order][1:] != d[order][:-1]) | (slot[order][1:] != slot[order][:-1])
            o = order[top]
            better = t[o] < least[d[o], slot[o]]
            o = o[better]
            least[d[o], slot[o]] = t[o]
            sign[d[o], slot[o]] = k[o] + _U(point)
            point += 1
        todo &= ~np.isfinite(least).all(axis=1)
        limit[todo] *= 2
        least[todo], sign[todo] = np.inf, 0
    return sign


def _text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(batch.column(batch.schema.get_field_index(name)))


def _parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of text bytes, one row at least."""
    worker_cache("neardups")
    sizes = sum(np.diff(_text_column(batch, c)[1]) for c in batch.schema.names if pa.types.is_string(batch.schema.field(c).type) or pa.types.is_large_string(batch.schema.field(c).type))
    at, n = 0, len(sizes)
    while at < n:
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")) + at)
        yield batch.slice(at, end - at)
        at = end
    give_back()


def band_keys(texts: DataFrame) -> DataFrame:
    """(id, bands: array of band hashes) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                data, offsets = _text_column(batch, "text")
                doc, shingle, count = multisets(data, offsets)
                sign = signatures(doc, shingle, count, batch.num_rows).reshape(batch.num_rows, BANDS, ROWS)
                some = np.bincount(doc, minlength=batch.num_rows) > 0
                with np.errstate(over="ignore"):
                    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sign.shape[:2])
                    for r in range(ROWS):
                        h = mix(h * _U(_ODD) + sign[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False)[some]), _lists(h[some].view(np.int64))], ["id", "bands"])

    return texts.select("id", "text").mapInArrow(run, "id long, bands array<long>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def long_signatures(texts: DataFrame) -> DataFrame:
    """(id, sig: low bytes of ``COMPARED`` components, seven to a long) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 1 << 20):
                sign = signatures(*multisets(*_text_column(batch, "text")), batch.num_rows, COMPARED)
                low = np.zeros((batch.num_rows, COMPARED // 7, 8), dtype=np.uint8)
                low[:, :, :7] = (mix(sign) & _U(0xFF)).reshape(len(low), COMPARED // 7, 7)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(low.reshape(len(low), -1).view(np.int64))], ["id", "sig"])

    return texts.select("id", "text").mapInArrow(run, "id long, sig array<long>")


def first_common(a: str, b: str, band: str) -> str:
    """SQL: whether ``band`` is the first band in which the arrays a and b agree."""
    firsts = " ".join(f"WHEN {a}[{i}] = {b}[{i}] THEN {a}[{i}]" for i in range(BANDS))
    return f"(CASE {firsts} END) = {band}"


def alike(a: str, b: str) -> str:
    """SQL: whether enough low bytes agree. x ^ y has a zero byte where they do; those of seven are counted at once."""
    low, high = f"{0x7F7F7F7F7F7F7F}L", f"{0x80808080808080}L"
    equal = f"zip_with({a}, {b}, (x, y) -> bit_count(~(((x ^ y) & {low}) + {low} | (x ^ y) | {low}) & {high}))"
    return f"aggregate({equal}, 0, (n, k) -> n + k) >= {AGREEING}"


def shareable(texts: DataFrame) -> DataFrame:
    """(id, n: number of shingles, c: number of those that a text of another root has too) of (id, text, root).

    A combined aggregate over shingle hashes keeps the shingles of several roots; a plain join counts them by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                doc, shingle, count = multisets(*_text_column(batch, "text"))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int32))], ["id", "root", "h", "w"])

    rows = materialize(texts.select("id", "text", "root").mapInArrow(run, "id long, root long, h long, w int"), "shingles")
    common = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    some = rows.join(common, "h", "left_semi").groupBy("id").agg(F.sum("w").alias("c"))
    return rows.groupBy("id").agg(F.sum("w").alias("n")).join(some, "id", "left").select("id", "n", F.coalesce("c", F.lit(0)).alias("c"))


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two buffers, row by row."""
    n = len(a[1]) - 1
    da, ha, ca = multisets(*a)
    db, hb, cb = multisets(*b)
    doc, h, c = np.concatenate([da, db]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
    order = np.lexsort((h, doc))
    doc, h, c = doc[order], h[order], c[order]
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    both = np.bincount(doc[1:][same], weights=np.minimum(c[1:], c[:-1])[same], minlength=n)
    total = np.bincount(da, weights=ca, minlength=n) + np.bincount(db, weights=cb, minlength=n)
    return both / np.maximum(total - both, 1)


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose multisets are at least so similar. Both joins are plain equi-joins that Spark may split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                good = overlaps(_text_column(batch, "a"), _text_column(batch, "b")) >= least - 1e-12
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["u", "v"])

    one = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    both = one.join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, text_id): one row per row of ``docs``; class_id is the least id of the near-duplicate class."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    # equal texts: one representative, the least id, by a combined aggregate over digests
    blank = F.concat(F.lit("id:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    said = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    digest = F.when(said, F.sha2("text", 256)).otherwise(blank)
    rows = rows.withColumn("digest", digest)
    same = materialize(rows.select("id", "digest"), "digests")
    kept = materialize(rows.groupBy("digest").agg(F.min("id").alias("rep"), F.first("text").alias("text")), "representatives")
    reps = kept.select("digest", "rep")
    keys = materialize(band_keys(kept.select(F.col("rep").alias("id"), "text")), "keys")
    bands = materialize(keys.select("id", F.explode("bands").alias("band")).distinct(), "bands")
    buckets = bands.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    members = materialize(bands.join(buckets, "band"), "members")
    degrees = members.groupBy("id").agg(F.sum("k").alias("degree"))
    # only texts that share a bucket are ever compared; of several texts with one id the least stands for it
    texts = kept.select(F.col("rep").alias("id"), "text").join(degrees, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    texts = materialize(texts, "texts")
    discard(bands)

    central = members.join(degrees, "id")
    pivots = central.groupBy("band").agg(F.max(F.struct("degree", "id")).alias("p"), F.min(F.struct(F.xxhash64("id", "band").alias("h"), "id")).alias("q"))
    tries = members.join(pivots, "band").select("id", F.explode(F.array("p.id", "q.id")).alias("pivot")).where("id <> pivot")
    tries = materialize(tries.select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")).distinct(), "pairs")
    links = materialize(verified(tries, texts), "links")
    roots = materialize(components(links), "roots")

    # buckets that still hold several components: members outside the largest one against the others
    held = members.join(roots, F.col("id") == F.col("node"), "left").select("id", "band", F.coalesce("root", "id").alias("root"))
    sizes = held.groupBy("band", "root").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    held = materialize(held.join(mixed.select("band", "main"), "band"), "held")
    left = materialize(texts.join(held.select("id", "root").distinct(), "id").select("id", "text", "root"), "left")
    bounds = shareable(left).where(F.col("c") >= SIMILARITY * F.col("n") - 1e-9)
    # a text links with none if even a text of just its shared part would be too far away
    bounds = bounds.join(keys.groupBy("id").agg(F.min("bands").alias("bands")), "id").join(long_signatures(left), "id")
    held = materialize(held.join(materialize(bounds, "bounds"), "id"), "held")
    outside = held.where("root <> main").select("band", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("bands").alias("bands_x"), F.col("sig").alias("sig_x"))
    apart = (F.col("root") != F.col("rx")) & ((F.col("root") == F.col("main")) | (F.col("id") < F.col("x")))
    most = F.least("c", "cx")  # of the overlap
    near = most >= SIMILARITY * (F.col("n") + F.col("nx") - most) - 1e-9
    once = F.expr(first_common("bands", "bands_x", "band")) & F.expr(alike("sig", "sig_x"))
    pairs = held.join(outside, "band").where(apart & near & once).select(F.least("id", "x").alias("u"), F.greatest("id", "x").alias("v")).distinct()
    more = materialize(verified(materialize(pairs.join(tries, ["u", "v"], "left_anti"), "pairs"), texts), "links")
    if not more.isEmpty():
        roots = materialize(components(links.unionByName(more)), "roots")
    out = same.join(reps, "digest").join(roots, F.col("rep") == F.col("node"), "left")
    return out.select("id", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("text_id"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of the class) and kept (whether it is that document)."""
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one of least id, and one row of it (of several texts the least).

    All columns are kept, whatever their names. Rows with a null id name no document and stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    kept = classes(rows.where("id IS NOT NULL"), "id", "text").where("id = class_id").select("id").distinct()
    one = rows.join(kept, "id", "left_semi")
    repeated = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        one = one.groupBy("id").agg(F.min_by("doc", F.coalesce("text", F.lit(""))).alias("doc"))
    one = one.select("doc").unionByName(rows.where("id IS NULL").select("doc"))
    return one.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
