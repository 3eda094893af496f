"""Scores against dictionaries of counts and the recursive formula, and probabilities that add up to one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from sessionloom.llm import scoring

from ..conftest import SMALL


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts, order, prior):
        self.order, self.prior = order, prior
        self.counts, self.contexts, self.texts = Counter(), Counter(), len(texts)
        for text in texts:
            said = ["<s>", *self.tokens(text)]
            for i in range(1, len(said)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        self.counts[tuple(said[i - n + 1 : i + 1])] += 1
                        self.contexts[tuple(said[i - n + 1 : i])] += 1
        single = [c for k, c in self.counts.items() if len(k) == 1]
        self.n, self.v = sum(single), len(single)
        once, twice = single.count(1), single.count(2)
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    @staticmethod
    def tokens(text):
        return [*re.findall("[^\x20\x09-\x0d]+", lower(text)), ""]

    def p(self, word, context):
        if not context:
            c = self.counts[(word,)]
            return (1.0 if not self.n else (c - self.discount) / self.n if c else self.discount * self.v / self.n)
        rest, n = self.p(word, context[1:]), self.contexts[context]
        return (self.counts[(*context, word)] + self.prior * rest) / (n + self.prior) if n else rest

    def score(self, text):
        said = ["<s>", *self.tokens(text)]
        return sum(math.log10(self.p(said[i], tuple(said[max(0, i - self.order + 1) : i]))) for i in range(1, len(said)))


def compare(frame, texts, order, prior, **sizes):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in texts}
    model = Plain([t for d, t in texts if not held[d]], order, prior)
    got = sorted((tuple(r) for r in scoring.score_texts(frame, ~scoring.held_out(), order, prior, **sizes).collect()), key=repr)
    want = []
    for d, t in texts:
        said = model.tokens(t)
        counts = [model.counts[(w,)] for w in said]
        base = sum(math.log10((c + 1) / (model.n + model.v + 1)) for c in counts)
        want.append((d, held[d], len(said), sum(c > 0 for c in counts), model.n, base, model.score(t)))
    want.sort(key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose(sorted(r[5] for r in got), sorted(r[5] for r in want), rtol=1e-9)
    assert np.allclose(sorted(r[6] for r in got), sorted(r[6] for r in want), rtol=1e-9)
    return model


@pytest.mark.parametrize(("order", "block", "per_bucket"), [(1, 1 << 10, 50), (2, 1 << 10, 50), (3, 1 << 10, 200), (4, 1 << 20, 1 << 20)])
def test_against_dictionaries(spark, order, block, per_bucket):
    draw = random.Random(order)
    words = "the The cat É é sat on a mat. \x0b \x1f x".split(" ")
    texts = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))) for k in range(300)] + [(None, "null id"), (900, None), (901, ""), (902, "  the\t\n"), (5, "the cat"), (5, "the cat")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    model = compare(frame, texts, order, 3.0, block=block, per_bucket=per_bucket)
    for context in [(), ("the",), ("<s>",), ("cat", "the"), ("nowhere",), ("<s>", "the", "cat")]:
        known = {k[0] for k in model.counts if len(k) == 1}
        assert abs(sum(model.p(w, context[: order - 1]) for w in known) + model.p("\n", context[: order - 1]) - 1) < 1e-9


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    compare(docs, [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], scoring.ORDER, scoring.PRIOR)


def test_model_beats_base_on_held_out_texts(spark):
    rows = scoring.scoring_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    base, score = rows.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_edges(spark):
    schema = "doc_id long, text string, block long, held string"
    assert scoring.scoring_report(spark.createDataFrame([], schema)).count() == 0
    only = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    got = scoring.scoring_report(spark.createDataFrame([(only, "nothing to learn from", 1, "x")], schema)).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"], got["score"]) == (5, 0, 0, 0.0, 0.0)
    long = spark.createDataFrame([(only + 1, "word " * 500_000, 1, "x")], schema)
    assert scoring.scoring_report(long).first()["n_tokens"] == 500_001


def test_packing_of_keys_and_counts():
    draw = np.random.default_rng(2)
    for n in (1, 2, 1000):
        keys = np.sort(draw.integers(0, 1 << 64, n, dtype=np.uint64))
        assert np.array_equal(scoring.unpack_sorted(scoring.pack_sorted(keys)), keys)
    for top in (0, 255, 256, 70_000, 1 << 40):
        assert np.array_equal(scoring.unsmall(scoring.small(np.array([0, top]))), [0, top])
