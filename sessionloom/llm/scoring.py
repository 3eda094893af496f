"""Language-model scores of texts by a weighted backoff automaton over word n-grams.

The model counts the n-grams of all training texts, up to ``order`` words. A context that was seen is a state; an
n-gram that was seen is an arc from its context's state with a smoothed log-probability, to the state of the longest
suffix that is a context; every other word leaves by the failure arc, which costs its share of the probability and leads to the
state of the context without its first word. Counts of higher orders are smoothed towards the next lower one with the
weight of ``PRIOR`` words (a Dirichlet prior); single words are discounted by the corpus's share of words seen once and
twice, and the mass so freed is that of the unknown word. Each state's probabilities add up to one.

The model of a large corpus fits no worker, so each block of documents gets the part of the automaton that its own
texts can reach:

1. Documents are tokenised in blocks of ``BLOCK`` bytes of text and written as numbers into the block's own words.
2. Each block asks for the corpus counts of its distinct n-grams: requests go by hash range to buckets, whose number grows
   with the requests, so a bucket holds about ``PER_BUCKET`` of them whatever the corpus. A frequent n-gram is one request
   a block. Buckets add up training counts and answer; words are compared as text, longer n-grams by 64-bit keys (for n
   n-grams two share a key with probability below n² / 2^65; base counts don't rest on them).
3. Each block builds its part of the automaton from the answers and its texts go through it, each token from left to
   right with the state that the words before it lead to; all tokens of a block move at once.

Defined cases: a null or empty text is its end alone; a null id is in the training part, as its crc32 is not 2 modulo 7; repeated
rows count as often as they stand; without training texts the unknown word has probability one; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import text_blocks
from .common import give_back, materialize

ORDER = 2
#: Weight of the next lower order, in words.
PRIOR = 500.0
BLOCK = 16 << 20
PER_BUCKET = 1 << 20
_MIX, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x51ED270B0A1F39C1)

#: Words are joined by line feeds, in the order of their hashes; the end of a text is the empty word.
BLOCKS = "block long, docs array<long>, held array<boolean>, cuts binary, codes binary, words binary, n_words long, n_tokens long, n_train long"


def held_out(id_col: str = "doc_id"):
    """The contract's fold: crc32 of the id as text is 2 modulo 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _block(number: int, batch: pa.RecordBatch) -> dict:
    own = batch.column(1).take(pa.array(np.arange(batch.num_rows)))  # a slice's characters begin elsewhere, which splitting does not heed
    texts = pc.ascii_lower(pc.fill_null(own.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.values.cast(pa.large_binary()).slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    shown = np.array([len(w) > 0 for w in words], dtype=bool)[codes] if len(words) else np.zeros(0, dtype=bool)
    upto = np.concatenate([[0], np.cumsum(shown)])[ends]  # blanks at either side of a text give empty words
    codes = codes[shown]
    if b"" not in words:
        words.append(b"")
    codes = np.insert(codes, upto[1:], words.index(b""))  # each text ends with the empty word
    cuts = upto + np.arange(len(upto))
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    held = batch.column(2)
    return {"block": number, "docs": batch.column(0).to_pylist(), "held": held.to_pylist(), "cuts": cuts.astype("<i8").tobytes(), "codes": place[codes].astype("<i4").tobytes(), "words": b"\n".join(words[k] for k in order), "n_words": len(words), "n_tokens": len(codes), "n_train": batch.num_rows - (held.true_count or 0)}


class Grams:
    """The distinct n-grams of a written block by level: ``keys`` in order, ``of`` by token (-1 where the text is too short),
    ``train`` counts of the block's training texts."""

    def __init__(self, row: dict, order: int, numbered: bool):
        self.words = row["words"].split(b"\n")
        codes, cuts = np.frombuffer(row["codes"], "<i4"), np.frombuffer(row["cuts"], "<i8")
        self.codes, self.cuts = codes, cuts
        self.begins = np.zeros(len(codes), dtype=bool)
        self.begins[cuts[:-1]] = True
        trains = np.repeat(~np.array(row["held"], dtype=bool), np.diff(cuts))
        own = word_hashes(self.words)
        self.keys, self.of = [own], [codes]
        self.train = [np.bincount(codes[trains], minlength=len(own))]
        before, long = own[codes], np.ones(len(codes), dtype=bool)
        for level in range(2, order + 1):
            # the context is the n-gram that ends one word earlier; in front of a text stands one start mark
            context, known = np.empty_like(before), np.zeros(len(codes), dtype=bool)
            context[1:], known[1:] = before[:-1], long[:-1]
            known[self.begins] = level == 2
            context[self.begins] = _START
            mixed = (context ^ (context >> np.uint64(31))) * _MIX + own[codes]
            before, long = (mixed ^ (mixed >> np.uint64(29))) * _MIX, known
            at = np.flatnonzero(known)
            if numbered:
                keys, back = np.unique(before[at], return_inverse=True)
                of = np.full(len(codes), -1, dtype=np.int64)
                of[at] = back
                self.of.append(of)
                self.train.append(np.bincount(back[trains[at]], minlength=len(keys)))
            else:
                some = np.sort(before[at])
                first = np.flatnonzero(np.append(True, some[1:] != some[:-1])[: len(some)])
                keys, train = some[first], np.zeros(len(first), dtype=np.int64)
                own_part = np.sort(before[at][trains[at]])
                start = np.flatnonzero(np.append(True, own_part[1:] != own_part[:-1])[: len(own_part)])
                train[np.searchsorted(keys, own_part[start])] = np.diff(np.append(start, len(own_part)))
                self.train.append(train)
            self.keys.append(keys)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as steps, in as few bytes each as the longest needs."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(steps) > 1 else 1
    first = steps[:1].tobytes()
    return bytes([width]) + first + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    width, first = raw[0], np.frombuffer(raw[1:9], "<u8")
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    rest = np.frombuffer(raw[9:], np.uint8).reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), dtype=np.uint8)
    steps[1:, :width] = rest
    steps = steps.view("<u8").ravel()
    steps[0] = first[0]
    return np.cumsum(steps, dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    most = int(counts.max()) if len(counts) else 0
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if most < 1 << (8 * int(k[-1])))
    return bytes([int(kind[-1])]) + counts.astype(kind).tobytes()


def unsmall(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], f"<u{raw[0]}").astype(np.int64)


def count_requests(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    """bucket, level, block, keys and training counts: each block's distinct n-grams, cut by hash range."""
    bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams, out = Grams(row, order, numbered=False), []
                for level, (keys, train) in enumerate(zip(grams.keys, grams.train, strict=True), 1):
                    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                    for b, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if end > start:
                            said = b"\n".join(grams.words[start:end]) if level == 1 else pack_sorted(keys[start:end])
                            out.append((b, level, row["block"], said, small(train[start:end])))
                del grams
                give_back()
                columns = zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["bucket", "level", "block", "keys", "counts"])

    return blocks.select("block", "held", "cuts", "codes", "words").mapInArrow(run, "bucket int, level int, block long, keys binary, counts binary")


ANSWER = "block long, level int, bucket int, counts binary, tokens long, words long, once long, twice long"


def answer(table: pa.Table) -> pa.Table:
    """One bucket's training counts for all blocks that asked, and the sums over its words in a row without a block."""
    rows, out = table.to_pylist(), []
    for level in sorted({r["level"] for r in rows}):
        asked = [r for r in rows if r["level"] == level]
        counts = [unsmall(r["counts"]) for r in asked]
        if level == 1:
            keys = [r["keys"].split(b"\n") for r in asked]
            coded = pa.chunked_array([pa.array(k, pa.binary()) for k in keys]).combine_chunks().dictionary_encode()
            of, n = coded.indices.to_numpy(), len(coded.dictionary)
        else:
            every = np.concatenate([unpack_sorted(r["keys"]) for r in asked])
            keys, of = np.unique(every, return_inverse=True)
            n = len(keys)
        total = np.bincount(of, weights=np.concatenate(counts), minlength=n).astype(np.int64)
        ends = np.cumsum([len(c) for c in counts])
        for r, c, end in zip(asked, counts, ends, strict=True):
            out.append((r["block"], level, r["bucket"], small(total[of[end - len(c) : end]]), 0, 0, 0, 0))
        if level == 1:
            out.append((None, 1, asked[0]["bucket"], b"", int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "level", "bucket", "counts", "tokens", "words", "once", "twice"])


class Corpus:
    """Sums over the training texts: tokens, different words, words seen once and twice, texts."""

    def __init__(self, tokens: int, words: int, once: int, twice: int, texts: int):
        self.tokens, self.words, self.texts = tokens, words, texts
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of single words with these counts; a count of 0 is the unknown word."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, counts - self.discount, self.discount * self.words) / self.tokens

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + (self.words + 1)))


class Automaton:
    """The part of the model that a block's texts reach. By level and n-gram number: ``seen`` (an arc), ``weight`` (its
    log10 probability), ``leave`` (the failure weight of its context's state; 0 and no state where the context was not seen)."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], corpus: Corpus, prior: float):
        probability = corpus.single(totals[0])
        self.seen, self.weight, self.leave = [np.ones(len(probability), dtype=bool)], [np.log10(probability)], [np.zeros(len(probability))]
        for level in range(1, len(totals)):
            of, lower = grams.of[level], grams.of[level - 1]
            at = np.flatnonzero(of >= 0)
            first = np.zeros(len(totals[level]), dtype=np.int64)
            first[of[at]] = at  # any token that ends this n-gram
            context = np.full(len(first), corpus.texts if level == 1 else 0)
            inner = ~grams.begins[first]
            context[inner] = totals[level - 1][lower[first[inner] - 1]]
            state = context > 0
            share = np.where(state, prior / (context + prior), 1.0)
            probability = np.where(state, totals[level] / (context + prior), 0.0) + share * probability[lower[first]]
            self.seen.append(totals[level] > 0)
            self.weight.append(np.log10(probability))
            self.leave.append(np.log10(share))

    def traverse(self, grams: Grams) -> np.ndarray:
        """log10 probability of each token: along the arc of the longest context that has one, past the failure arcs of the longer ones."""
        score, open_ = np.zeros(len(grams.codes)), np.arange(len(grams.codes))
        for level in range(len(self.seen) - 1, -1, -1):
            of = grams.of[level][open_]
            there = of >= 0  # at a text's beginning the state is a shorter context
            arc = there.copy()
            arc[there] = self.seen[level][of[there]]
            score[open_[arc]] += self.weight[level][of[arc]]
            fails = there & ~arc
            score[open_[fails]] += self.leave[level][of[fails]]
            open_ = open_[~arc]
        return score


def score_texts(docs: DataFrame, training, order: int = ORDER, prior: float = PRIOR, block: int = BLOCK, per_bucket: int = PER_BUCKET, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text; ``training`` is a condition of
    the texts that the model is learned from."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        kinds = {"docs": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), **dict.fromkeys(("cuts", "codes", "words"), pa.binary())}
        for batch in batches:
            for at, n in text_blocks(batch.column(1), block):
                row = _block(k, batch.slice(at, n))
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(c, pa.int64())) for c, v in row.items()], list(row))
                give_back()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (~training).alias("held"))
    blocks = materialize(picked.mapInArrow(number, BLOCKS), "numbered")
    sums = blocks.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t"), F.sum("n_train").alias("d")).first()
    buckets = max(1, -(-((sums["w"] or 0) + (order - 1) * (sums["t"] or 0)) // per_bucket))
    requests = count_requests(blocks, buckets, order)
    answers = materialize(requests.groupBy("bucket").applyInArrow(answer, ANSWER), "answers")
    totals = answers.where("block IS NULL").agg(*[F.sum(c).alias(c) for c in ("tokens", "words", "once", "twice")]).first()
    corpus = Corpus(*[x or 0 for x in totals], sums["d"] or 0)
    told = answers.where("block IS NOT NULL").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("level", "bucket", "counts"))).alias("told"))
    rows = blocks.select("block", "docs", "held", "cuts", "codes", "words").join(told, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams = Grams(row, order, numbered=True)
                found = [np.concatenate([np.zeros(0, np.int64), *[unsmall(t["counts"]) for t in row["told"] if t["level"] == n + 1]]) for n in range(order)]
                score = Automaton(grams, found, corpus, prior).traverse(grams)
                count, starts = found[0][grams.codes], grams.cuts[:-1]
                base = corpus.base(found[0])[grams.codes]
                columns = [np.diff(grams.cuts), np.add.reduceat((count > 0).astype(np.int64), starts), np.full(len(starts), corpus.tokens), np.add.reduceat(base, starts), np.add.reduceat(score, starts)]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del grams
                give_back()

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scoring_report(docs: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """The contract's columns."""
    return score_texts(docs, ~held_out(), order, prior)
