"""Token alignment against plain loops over the documents, with both tokenizers run on whole texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from sessionloom.llm import alignment

from ..conftest import SMALL


def plain(texts):
    """The contract's rows by reading it literally."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_level()
    rows, holders, linked = {}, Counter(), {}
    for doc, text in texts:
        rows[doc] = (0, 0, 0, 0, "")
        linked[doc] = Counter()
        if not text:
            continue
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            group = ([], [])
            while i < len(a) and ends_a[i] <= cut:
                group[0].append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                group[1].append(b[j])
                j += 1
            groups.append(group)
        for x, y in groups:
            for p in x:
                linked[doc].update((p, q) for q in y)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows[doc] = (len(a), len(b), len(groups), sum(linked[doc].values()), hashlib.sha256(said.encode()).hexdigest())
        holders.update(linked[doc].keys())
    most = defaultdict(int)
    for (p, _), n in holders.items():
        most[p] = max(most[p], n)
    out = set()
    for doc, (n_a, n_b, n_groups, n_links, said) in rows.items():
        best = sum(n for (p, q), n in linked[doc].items() if holders[p, q] == most[p])
        out.add((doc, n_a, n_b, n_groups, n_links, best, sum(n * holders[k] for k, n in linked[doc].items()), said))
    return out


ODD = ["", " ", "  ", "\n", "\n\n", " \n ", "\t", "▁", "<|endoftext|>", "</s>", "<s>", "<0x0A>", "é", "日本", "é", "🙂", "　", " ", "'s", "don't", "   x", "x   ", "A" * 40, "0123456789", "…", " ", "Я", "ﬁ", "½", "\x00", "\r\n", "a b c d", "==  ==", "     "]


@pytest.mark.parametrize("block", [1 << 12, 4 << 20])
def test_against_plain_loops(spark, block):
    draw = random.Random(4)
    words = "the of that Über straße naïve token, re-use. (x) 3.14 www a I".split()
    texts = [(k, t) for k, t in enumerate([None, *ODD])]
    for k in range(400):
        glue = draw.choice([" ", " ", "\n", ""])
        texts.append((1000 + k, glue.join(draw.choice(words if draw.random() < 0.8 else ODD) for _ in range(draw.randint(1, 40)))))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in alignment.alignment_report(frame, block=block).collect()}
    assert got == plain(texts)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in alignment.alignment_report(docs).collect()} == plain(texts)


def test_coalesce_breaks_where_a_start_reaches_the_greatest_end():
    starts, ends, side = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 6, 3, 5, 6]), np.array([0, 0, 0, 1, 1, 1])
    order, group = alignment.coalesce(starts, ends, side)
    assert group.tolist() == [0, 0, 0, 0, 1, 1] and order.tolist() == [0, 3, 1, 4, 2, 5]


def test_edges(spark):
    assert alignment.alignment_report(spark.createDataFrame([], "doc_id long, text string, pair long")).count() == 0
    rows = [(1, None, 7), (1, "same text", 8), (1, "same text", 9), (None, "", 1)]
    got = alignment.alignment_report(spark.createDataFrame(rows, "doc_id long, text string, pair long")).collect()
    assert len(got) == 4 and sum(r["n_a"] > 0 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1


def test_one_giant_group_is_counted_by_distinct_ids(spark):
    text = "=" * 200_000 + "▁"[:0]
    got = alignment.alignment_report(spark.createDataFrame([(1, text), (2, "==" + text)], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and all(r["n_links"] >= r["n_a"] for r in got)


def test_a_task_holds_one_block(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(alignment, "materialize", lambda df, name, *more, f=alignment.materialize: steps.append(f(df, name, *more)) or steps[-1])
    report = alignment.alignment_report(spark.createDataFrame([(k, f"some words of text {k}") for k in range(50)], "doc_id long, text string").coalesce(1), block=64)
    files = [f.removeprefix("file:") for f in steps[0].inputFiles()]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert sum(g.num_rows for g in groups) > 10 and all(g.num_row_groups == g.num_rows for g in groups)
    assert "FlatMapCoGroupsInArrow" in report._jdf.queryExecution().toString() and report.count() == 50


def test_weights_of_any_size():
    for most, kind in ((0, "<u1"), (255, "<u1"), (256, "<u2"), (1 << 16, "<u4"), (1 << 32, "<u8")):
        assert alignment.narrow(np.array([1, most])) == kind
    assert alignment.narrow(np.zeros(0, np.int64)) == "<u1"
