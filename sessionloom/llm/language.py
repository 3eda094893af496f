"""Language identification by segmentation-marginalised unigram models.

A language is a probability for each piece of a fixed public vocabulary (the tokenizer file's pieces; no tokenizer
is trained). The likelihood of a word is the sum over all its segmentations into pieces, by the forward
algorithm; a text is its words (runs of letters, lower-cased, with the vocabulary's word-start mark in front).
Piece probabilities are estimated by expectation-maximisation, where the expectation step is the
forward-backward algorithm over the same segmentations.

Training counts the words of a bounded sample of labelled texts in Spark (``TRAIN_DOCS`` a language, whole texts)
and sums expected piece counts in Spark; only one number for each language and piece reaches the driver. Scoring
runs on every text whole, in Arrow batches without a shuffle; each Python worker keeps a bounded cache of word
likelihoods, and words that are not in it are scored together by array operations.

Defined cases: a null text or one without letters is ``und`` with score 0; texts without labelled languages are
``und`` too; repeated rows are scored row by row; ties go to the language that sorts first; extra columns are kept.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, worker_cache

#: Bound of the labelled sample: texts for each language (expected number; the draw is by hash).
TRAIN_DOCS = 1500
#: Words whose likelihoods a worker keeps.
CACHED = 300_000
MARK = "▁"
#: Signs that ``\w`` takes for letters though their Unicode category is a number's: numerals such as ½, Ⅷ and ①.
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: Runs of letters, that is of Unicode's category L: for Python and for Spark's regular expressions.
LETTERS = re.compile(rf"[^\W\d_{NUMERALS}]+")
LETTERS_JVM = r"[\p{L}]+"
#: The same for texts without such signs, many times faster. One range stands for all beyond the first plane, so that the class
#: of signs stays a table.
QUICK = re.compile(r"[^\W\d_]+")
ODD, BEYOND = re.compile("[" + "".join(c for c in NUMERALS if c < "\U00010000") + "]"), re.compile("[\U00010000-\U0010ffff]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    low = text.lower()
    return (QUICK if low.isascii() or not (ODD.search(low) or BEYOND.search(low)) else LETTERS).findall(low)


def vocabulary(path: str | None = None) -> list[str]:
    """The lower-case letter pieces of a sentencepiece model file, of any length."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if LETTERS.fullmatch(p.removeprefix(MARK) or "a"))


class Lattice:
    """Array form of the forward and backward sums over all segmentations of many words."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)  # row of single characters outside the vocabulary
        self.none = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        # all beginnings of pieces, so that a start is left as soon as no piece goes on from there
        number = {p: i for i, p in enumerate(pieces)}
        hashes, rows = [], []
        for k in range(1, self.longest + 1):
            starts = sorted({p[:k] for p in pieces if len(p) >= k})
            hashes.append(self._hash(self._codes(starts, k)))
            rows.append(np.array([number.get(x, self.unknown if k == 1 else self.none) for x in starts], dtype=np.int32))
        found = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        order = np.argsort(found)
        self.hashes, self.rows = found[order], np.concatenate([np.zeros(0, dtype=np.int32), *rows])[order]

    @staticmethod
    def _codes(words: list[str], n: int) -> np.ndarray:
        return np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)

    @staticmethod
    def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        h = (h ^ codes) * _PRIME
        return h ^ (h >> np.uint64(29))

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), dtype=np.uint64)
        for k in range(codes.shape[1]):
            h = self._mix(h, codes[:, k])
        return h

    def ids(self, words: list[str]) -> tuple[np.ndarray, int]:
        """For words of one length n (mark included): ids[start, size - 1, word] of the pieces, ``none`` where there is none."""
        n = len(words[0])
        codes = self._codes(words, n)
        ids = np.full((n, min(self.longest, n), len(words)), self.none, dtype=np.int32)
        ids[:, 0] = self.unknown
        for i in range(n):
            h, alive = np.zeros(len(words), dtype=np.uint64), np.arange(len(words))
            for k in range(min(self.longest, n - i)):
                h = self._mix(h, codes[alive, i + k])
                at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
                hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
                h, alive = h[hit], alive[hit]
                if not len(alive):
                    break
                ids[i, k, alive] = self.rows[at[hit]]
        return ids, n

    def _steps(self, ids: np.ndarray, n: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By start and size: the words that have a piece there, and its row."""
        found = {}
        for i in range(n):
            for k in range(1, min(ids.shape[1], n - i) + 1):
                words = np.flatnonzero(ids[i, k - 1] != self.none)
                if len(words):
                    found[i, k] = words, ids[i, k - 1, words]
        return found

    def forward(self, ids: np.ndarray, n: int, probs: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations: [word, language]. ``probs``: [piece, language]."""
        steps, width = self._steps(ids, n), ids.shape[1]
        ring: list[np.ndarray] = [np.ones((ids.shape[2], probs.shape[1]))]
        scale = np.zeros((ids.shape[2], 1))
        for j in range(1, n + 1):
            now = np.zeros_like(ring[0])
            for k in range(1, min(width, j) + 1):
                if (j - k, k) in steps:
                    words, rows = steps[j - k, k]
                    now[words] += ring[-k][words] * probs[rows]
            ring = [*ring[-(width - 1) :], now] if width > 1 else [now]
            if j % 16 == 0:
                top = np.maximum(now.max(axis=1, keepdims=True), 1e-300)
                ring = [x / top for x in ring]
                scale += np.log(top)
        return np.log(np.maximum(ring[-1], 1e-300)) + scale

    def expected(self, ids: np.ndarray, n: int, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts under all segmentations for one language's column of ``probs``. Sums of long words are
        taken in logarithms, so that they don't vanish."""
        if n > 64:
            return self._expected_long(ids, n, probs, counts)
        steps, width = self._steps(ids, n), ids.shape[1]
        f, b = np.zeros((n + 1, ids.shape[2])), np.zeros((n + 1, ids.shape[2]))
        f[0], b[n] = 1, 1
        for j in range(1, n + 1):
            for k in range(1, min(width, j) + 1):
                if (j - k, k) in steps:
                    words, rows = steps[j - k, k]
                    f[j, words] += f[j - k, words] * probs[rows]
        for i in range(n - 1, -1, -1):
            for k in range(1, min(width, n - i) + 1):
                if (i, k) in steps:
                    words, rows = steps[i, k]
                    b[i, words] += b[i + k, words] * probs[rows]
        out = np.zeros(len(probs))
        share = counts / np.maximum(f[n], 1e-300)
        for (i, k), (words, rows) in steps.items():
            out += np.bincount(rows, weights=f[i, words] * probs[rows] * b[i + k, words] * share[words], minlength=len(probs))
        return out

    def _expected_long(self, ids: np.ndarray, n: int, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out, width = np.zeros(len(probs)), ids.shape[1]
        logs = np.log(np.maximum(probs, 1e-300))
        logs[self.none] = -np.inf
        f, b = np.full((n + 1, ids.shape[2]), -np.inf), np.full((n + 1, ids.shape[2]), -np.inf)
        f[0], b[n] = 0, 0
        for j in range(1, n + 1):
            f[j] = np.logaddexp.reduce([f[j - k] + logs[ids[j - k, k - 1]] for k in range(1, min(width, j) + 1)])
        for i in range(n - 1, -1, -1):
            b[i] = np.logaddexp.reduce([b[i + k] + logs[ids[i, k - 1]] for k in range(1, min(width, n - i) + 1)])
        for (i, k), (words, rows) in self._steps(ids, n).items():
            share = np.exp(f[i, words] + logs[rows] + b[i + k, words] - f[n, words])
            out += np.bincount(rows, weights=share * counts[words], minlength=len(probs))
        return out


def _by_length(words: list[str]) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for g in groups.values():
        step = max(1, (8192 * 16) // max(16, len(words[g[0]])))  # so that a group of long words takes no more memory
        for at in range(0, len(g), step):
            yield g[at : at + step]


class Model(NamedTuple):
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # [piece and the unknown character and none, language]


class Scorer:
    """Language likelihoods of whole texts; keeps the likelihoods of up to ``CACHED`` words."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((4096, len(self.model.languages)))

    def _learn(self, words: list[str]) -> None:
        start = len(self.known)
        if start + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(start, len(words)), self.scores.shape[1]))])
        marked = [MARK + w for w in words]
        for group in _by_length(marked):
            ids, n = self.lattice.ids([marked[i] for i in group])
            self.scores[start + np.array(group)] = self.lattice.forward(ids, n, self.model.probs)
        for i, w in enumerate(words):
            self.known[w] = start + i

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, sure = [], []
        for at in range(0, len(texts), 512):
            words = [words_of(t) if t else [] for t in texts[at : at + 512]]
            if len(self.known) > CACHED:
                self._clear()
            fresh = set().union(*words).difference(self.known) if words else set()
            if fresh:
                self._learn(sorted(fresh))
            for w in words:
                if not w or not self.model.languages:
                    labels.append("und")
                    sure.append(0.0)
                    continue
                total = self.scores[np.fromiter(map(self.known.__getitem__, w), dtype=np.int64, count=len(w))].sum(axis=0)
                best = int(total.argmax())
                labels.append(self.model.languages[best])
                sure.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return labels, sure


def worker_scorer(key: str, model: Model) -> Scorer:
    """The worker's scorer of a model, kept between the tasks of one query in a reused Python worker."""
    cache = worker_cache("language")
    if key not in cache:
        cache.clear()
        cache[key] = Scorer(model)
    return cache[key]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", path: str | None = None, sample: int = TRAIN_DOCS, rounds: int = 3) -> Model:
    """Fit on texts with a language. About ``sample`` texts of each language are drawn by a hash of the id."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang).alias("l"), F.col(text).alias("x"))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # one row a language
    languages, pieces = sorted(sizes), vocabulary(path)
    lattice = Lattice(pieces)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 2, 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))]), F.col("l"))
    drawn = rows.where((F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)) < share)
    words = drawn.select("l", F.explode(F.regexp_extract_all(F.lower("x"), F.lit(LETTERS_JVM), F.lit(0))).alias("w")).groupBy("l", "w").count()
    words = materialize(words, "words")
    probs = np.zeros((len(pieces) + 2, len(languages)))
    probs[:] = 1e-4 * np.array([0.25 ** (len(p.removeprefix(MARK)) < 2) for p in pieces] + [0.01, 0])[:, None]
    number = {k: i for i, k in enumerate(languages)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probs)  # pieces times languages

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                table = batch.to_pydict()
                by: dict[str, list[int]] = {}
                for i, k in enumerate(table["l"]):
                    by.setdefault(k, []).append(i)
                for k, rows_of in by.items():
                    col = number[k]
                    marked = [MARK + table["w"][i] for i in rows_of]
                    counts = np.array([table["count"][i] for i in rows_of], dtype=float)
                    for group in _by_length(marked):
                        ids, n = lattice.ids([marked[i] for i in group])
                        got = lattice.expected(ids, n, shared.value[:, col], counts[group])
                        sums[col] = sums[col] + got if col in sums else got
            for col, got in sums.items():
                some = np.flatnonzero(got)
                yield pa.RecordBatch.from_pydict({"language": pa.array(np.full(len(some), col), pa.int32()), "piece": pa.array(some.astype(np.int32)), "n": pa.array(got[some])})

        found = words.mapInArrow(expect, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(probs)
        counts[found["piece"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
        counts[:-2] += 0.05
        counts[-2] += 0.5
        probs = counts / counts.sum(axis=0)
        probs[-1] = 0
    return Model(languages, pieces, probs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language under equal priors."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(key, shared.value)
        for batch in batches:
            labels, sure = scorer(batch.column(batch.schema.get_field_index(text)).to_pylist())
            give_back()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """The contract's fold: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def language_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()), path=path)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5, path: str | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those whose language cannot be told: no letters at all, or a posterior below ``least``.

    All columns are kept, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    found = identify(rows.select("doc", "text"), fit(rows.select("doc_id", "text", "lang"), path=path))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def brute_force(word: str, probs: dict[str, float], unknown: float) -> float:
    """Test helper: log of the summed probability over all segmentations, by enumeration."""

    def rest(s: str) -> float:
        if not s:
            return 1.0
        return sum((probs.get(s[:k], unknown if k == 1 else 0.0)) * rest(s[k:]) for k in range(1, len(s) + 1))

    return math.log(rest(MARK + word))
