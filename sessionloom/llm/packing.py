"""Packing token sequences by shortest-pack-first over the length histogram.

1. Documents are tokenised whole in Arrow batches; a document is its ids and an end id, cut into pieces of at most
   ``size`` ids. Ids are found by distinct word (see :class:`WordTokenizer`), in slices of bounded size. Only piece
   descriptors are written.
2. The histogram of piece lengths (at most ``size`` rows, whatever the input) goes to the driver, where lengths
   are placed longest first into the emptiest pack that still has room, moving counts of packing patterns.
3. Patterns are joined back to pieces by rank within a length. The rank is the rank inside the block that wrote
   the piece plus the count of the same length in earlier blocks, so a hot length is never ranked in one task.

Defined cases: a null text is empty and gives a document of the end id alone; repeated rows are separate
documents; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, worker_cache

SIZE = 4096
END_ID = 2
#: Words in one generation of a worker's cache, and text bytes that are tokenised at once.
CACHED, SLICE = 150_000, 4 << 20
#: Signs that the tokenizer never joins to a letter: all of ASCII's but the apostrophe.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    """A tokenizer file's ids of whole texts, by way of their distinct words.

    Texts are cut at spaces and line feeds, which tokenizers of this kind drop and never join across; the words of a
    slice are made distinct, and ids are gathered by word number. A word of plain letters with signs behind it is
    that word and those signs. Letters are plain if their normal form and their lower case are one letter each; that the
    tokenizer agrees is tried on every one of them at the start, and another kind of tokenizer is refused. All
    other words go to the tokenizer as they are. Ids of letter words stay in a cache of two generations, of about
    ``CACHED`` words each: when the younger is full it becomes the older, and words met again come back from there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))]
        letters = [c for c in letters if c.isalpha() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha()]
        small = pc.utf8_lower(pa.array(letters)).to_pylist()
        self.split = f"^(?P<base>[{''.join(letters)}]+)(?P<signs>[{re.escape(SIGNS)}]*)$"
        both = self._ids(" ".join(letters)), self._ids(" ".join(small))
        agrees = all(int(self.ends[x].sum()) == len(letters) and self.ends[x[-1]] for x in both) and np.array_equal(*both)
        trial = [*letters[:60], "it's", "a\tb", *SIGNS]
        if not agrees or b"".join(self._each(trial)) != self._ids(" ".join(trial)).tobytes():
            raise ValueError(f"{path} is not a lower-casing tokenizer with word ends")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _each(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 1024):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(words[i : i + 1024], add_special_tokens=False)]
        return out

    def _plain(self, words: list[str]) -> list[bytes]:
        """Plain words are one word each to the tokenizer, so many are encoded as one text and cut at word ends."""
        if len(self.young) > CACHED:
            self.young, self.old = {"": b""}, self.young
        young, old = self.young, self.old
        fresh = []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    fresh.append(w)
        for i in range(0, len(fresh), 256):
            part = fresh[i : i + 256]
            ids = self._ids(" ".join(part))
            cuts, raw, at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes(), 0
            for w, c in zip(part, cuts, strict=True):
                young[w] = raw[at:c]
                at = c
        return list(map(young.__getitem__, words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (nulls are empty), and where each text's ids begin and end in them."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        ends = lists.offsets.to_numpy()
        flat = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        words, number = flat.dictionary, flat.indices.to_numpy()
        # each distinct word is two pieces: letters and signs, or itself and nothing
        halves = pc.extract_regex(words, self.split)
        base, signs = pc.utf8_lower(halves.field("base")).dictionary_encode(), halves.field("signs").dictionary_encode()
        is_odd = pc.is_null(halves).to_numpy(zero_copy_only=False)
        ids = [*self._plain(base.dictionary.to_pylist()), *self._each(signs.dictionary.to_pylist()), *self._each(words.filter(pa.array(is_odd)).to_pylist()), b""]
        pair = np.empty((len(words), 2), dtype=np.int64)
        pair[:, 0], pair[:, 1] = base.indices.fill_null(0).to_numpy(), signs.indices.fill_null(0).to_numpy() + len(base.dictionary)
        pair[is_odd, 0], pair[is_odd, 1] = np.arange(is_odd.sum()) + len(base.dictionary) + len(signs.dictionary), len(ids) - 1
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        every, upto = gather(np.frombuffer(b"".join(ids), dtype="<u4"), size, pair.ravel())
        upto = upto[::2]
        every, upto = gather(every, np.diff(upto), number)
        return every, upto[ends - ends[0]]


def gather(values: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``values`` (of the sizes ``size``, one behind another) numbered ``which``, and where each begins."""
    count = size[which]
    upto = np.concatenate([[0], np.cumsum(count)])
    kind = np.int32 if max(upto[-1], len(values)) < 1 << 31 else np.int64
    place = np.repeat(((np.cumsum(size) - size)[which] - upto[:-1]).astype(kind), count)
    place += np.arange(upto[-1], dtype=kind)
    return values[place], upto


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row numbers, texts) of about ``most`` bytes each; a longer text is cut at spaces and line feeds, which are left out."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        if sizes[at] <= most:
            yield np.arange(at, end), texts.slice(at, end - at)
        else:
            for part in re.finditer(rf"(?s)(?:.{{1,{most}}}[^ \n]*)", texts[at].as_py()):
                yield np.array([at]), pa.array([part[0]], pa.large_string())
            end = at + 1
        at = end


def tokenizer(path: str) -> WordTokenizer:
    """The worker's own tokenizer of that file."""
    cache = worker_cache("packing")
    if path not in cache:
        cache[path] = WordTokenizer(path)
    return cache[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block int, rank_in_block long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its checksum, the writing block and its rank among the block's pieces of that length."""
    path = path or default_tokenizer()
    tail = np.array([end_id], dtype="<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, seen = tokenizer(path), np.zeros(size + 1, dtype=np.int64)
        block = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            held, ids = -1, tail[:0]  # a long text comes in parts

            def close(batch=batch, rows=rows) -> None:
                whole = np.append(ids, tail)
                for start in range(0, len(whole), size):
                    part = whole[start : start + size]
                    rows.append((doc_ids[held], start, len(part), zlib.crc32(part), len(whole), block, int(seen[len(part)])))
                    seen[len(part)] += 1

            doc_ids = batch.column(0).to_pylist()
            for numbers, texts in slices(batch.column(1)):
                every, ends = tokenize(texts)
                for k, number in enumerate(numbers.tolist()):
                    part = every[ends[k] : ends[k + 1]]
                    if number == held:
                        ids = np.append(ids, part)
                        continue
                    if held >= 0:
                        close()
                    held, ids = number, part
            if held >= 0:
                close()
            columns = list(zip(*rows, strict=True)) or [()] * 7
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "rank_in_block"])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(cut, PIECE)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs). Works on counts: its cost does not grow with the documents.

    Lengths are taken longest first; each goes to the pack with the least total so far if it fits there.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    totals: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        total = sum(lengths)
        if not packs.get(total):
            heapq.heappush(totals, total)
            packs[total] = []
        packs[total].append((lengths, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if totals and not packs[totals[0]]:
                heapq.heappop(totals)
                continue
            if not totals or totals[0] + length > size:
                put((length,), left)
                left = 0
                continue
            lengths, n = packs[totals[0]].pop()
            used = min(n, left)
            if used < n:
                packs[totals[0]].append((lengths, n - used))
            put((*lengths, length), used)
            left -= used
    return [p for total in sorted(packs) for p in packs[total]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of slots, first sequence of the run, offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((n, base, offset))
            offset += x
        base += n
    out = {}
    for x, got in runs.items():
        n, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*got, strict=True))
        out[x] = (np.concatenate([[0], np.cumsum(n)[:-1]]), sequence, offset)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The contract's columns, one row per piece."""
    spark = docs.sparkSession
    table = materialize(pieces(docs, id_col, text, path, size, end_id), "pieces")
    counts = table.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))  # bounded by the histogram
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = table.join(base, ["block", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank_in_block") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                some = length == x
                first, ids, offsets = where.value[int(x)]
                run = np.searchsorted(first, rank[some], side="right") - 1
                sequence[some], offset[some] = ids[run] + rank[some] - first[run], offsets[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
