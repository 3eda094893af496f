"""Segments of turns against literals, and web queries against a plain search of all texts."""

import itertools
import random
import re

from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import segments, websearch

SCHEMA = """session_id long, turn_id long, ordinal int, actor_kind string, role string,
  parts array<struct<type:string,text:string,name:string,arguments:string,output:string,status:string,call_id:string>>, raw_span struct<char_start:long,char_end:long>"""


def part(kind, text, call=None):
    return (kind, text if kind == "text" else None, None, text if kind == "tool_call" else None, text if kind == "tool_result" else None, None, call)


def test_kinds_groups_chunks_and_spans(spark):
    words = " ".join(f"w{i}" for i in range(3000))
    secret = "fine line\npassword = hunter2hunter2\nlast line"
    noise = "QUJD" * 200
    turns = [
        (1, 10, 0, "human", "user", [part("text", "  hello   there ")], (100, 200)),
        (1, 11, 1, "agent", "assistant", [part("tool_call", "ls", "c1")], (200, 300)),
        (1, 12, 2, "agent", "tool", [part("tool_result", noise, "c1")], (300, 400)),
        (1, 13, 3, "agent", "tool", [part("tool_result", "twice", "c2")], None),
        (1, 14, 4, "agent", "assistant", [part("text", words)], (1000, 9000)),
        (1, 15, 5, "human", "user", [part("text", secret), part("text", "   "), part("text", noise)], (9000, 9100)),
        (1, 16, 6, "human", "user", [part("text", "")], (9100, 9100)),
        (1, 17, 7, "human", "user", [], (9100, 9100)),
        (2, 20, 0, "human", "user", None, None),
    ]
    rows = [r.asDict(True) for r in segments.derive(spark.createDataFrame(turns, SCHEMA)).orderBy("session_id", "segment").collect()]
    assert [r["segment"] for r in rows] == list(range(len(rows)))
    kinds = [(r["turn_id"], r["segment_kind"]) for r in rows]
    chunks = [k for k in kinds if k[0] == 14]
    assert len(chunks) == 4 and {k for _, k in chunks} == {"turn_chunk"}
    assert [k for k in kinds if k[0] != 14] == [(10, "turn"), (11, "tool_group_call"), (12, "tool_group_skipped"), (13, "turn"), (15, "turn"), (16, "turn_skipped")]
    by = {r["turn_id"]: r for r in rows if r["turn_id"] != 14}
    assert by[10]["search_text"] == "hello there" and by[10]["segment_raw_span"] == {"char_start": 100, "char_end": 200, "estimate": None}
    assert by[11]["group_ordinals"] == by[12]["group_ordinals"] == [1, 2] and (by[11]["member_index"], by[12]["member_index"]) == (0, 1)
    assert by[12]["filter_reasons"] == ["binary_or_base64"] and by[12]["search_text"] == "" and by[12]["segment_raw_span"] is None
    assert by[13]["group_call"] is None and by[13]["segment_raw_span"] is None
    assert by[15]["search_text"] == "fine line\nlast line" and by[15]["filter_reasons"] == ["binary_or_base64", "secret"] and by[15]["skipped_parts"] == 2
    for r in (r for r in rows if r["turn_id"] == 14):
        assert r["search_text"] == words[r["char_start"] : r["char_end"]] == " ".join(f"w{i}" for i in range(r["token_start"], r["token_end"]))
        assert r["segment_raw_span"]["char_start"] == min(1000 + r["char_start"], 9000) and r["segment_raw_span"]["char_end"] == min(1000 + r["char_end"], 9000)
        assert r["segment_raw_span"]["estimate"] == segments.ESTIMATE


def analyzed(text):
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in T.STOP_WORDS]


def plain_rank(query, text):
    """The rank by looking at every stretch of the text; None without a match."""
    found, terms = [], analyzed(text)
    clauses = [[]]
    for w in re.findall(r'-?"[^"]*"|[^\s"]+', query):
        if w.lower() == "or":
            clauses.append([])
        elif analyzed(w):
            clauses[-1].append((w.startswith("-"), analyzed(w)))
    holds = lambda part, item: any(part[i : i + len(item)] == item for i in range(len(part)))
    for clause in clauses:
        need, ban = [t for n, t in clause if not n], [t for n, t in clause if n]
        if not need or any(holds(terms, t) for t in ban) or not all(holds(terms, t) for t in need):
            continue
        full = [(a, b) for a, b in itertools.combinations(range(len(terms) + 1), 2) if all(holds(terms[a:b], t) for t in need)]
        least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
        found.append(sum(4 / max(4, b - a) for a, b in least))
    return max(found, default=None)


def test_web_queries_equal_a_plain_search(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("alpha beta gamma delta the eps".split()) for _ in range(rng.randrange(0, 16))) for _ in range(40)] + [None, ""]
    queries = ["alpha beta", '"alpha beta" gamma', "alpha -delta", 'alpha OR "beta gamma" -eps', "-alpha", "or or", "alpha alpha", '"alpha alpha" alpha', 'eps "the delta', "Alpha-Beta or GAMMA delta", "", None, "the of", 'beta "gamma beta" beta -"delta eps"']
    docs = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = {(r.query_id, r.segment_id): round(r.lexical, 9) for r in websearch.matches(docs, asked).collect()}
    want = {(q, s): plain_rank(query or "", text or "") for q, query in enumerate(queries) for s, text in enumerate(texts)}
    assert got == {k: round(v, 9) for k, v in want.items() if v is not None}


def test_headline(spark):
    rows = [("one two Three four five six seven eight nine ten", ["three"]), ("a b hit", ["hit"]), ("nothing here", ["hit"]), (None, ["hit"]), (" ".join(["hit"] * 30), ["hit"])]
    got = [r.h for r in spark.createDataFrame(rows, "text string, shown array<string>").select(websearch.headline(F.col("text"), F.col("shown")).alias("h")).collect()]
    assert got[:4] == ["<b>Three</b> four five six seven eight nine ten", "a b <b>hit</b>", None, None]
    assert got[4] == " ".join(["<b>hit</b>"] * 24)

