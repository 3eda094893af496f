"""Queries that take all rows, against brute force on small tables."""

import datetime
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import recall
from sessionloom.plans import events, retrieval, views

KINDS = ("signup", "view", "click", "purchase", "error")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four users whose events are an hour apart for each, so that every event is an interval."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=15 * i), i % 4, KINDS[i % 3 + 1], float(i % 7 * 50), "{}") for i in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def test_every_event_is_a_review(spark, folder):
    states = {(r["workspace_id"], r["claim_key"]): r["state"] for r in events.current_claims(spark, folder).collect()}
    means = {"accept": "supported", "reject": "rejected", "pin": "pinned", "promote": "promoted", "merge": "merged"}
    want = Counter()
    for i in range(100):
        action = ("accept", "reject", "pin", "promote", "merge", "noop")[i % 6]
        state = states.get((f"w{i % 4}", i % 4 + 3 * (i % 20 // 10)))
        refused = "unknown_claim" if state is None else "terminal_claim" if action == "promote" and state in ("rejected", "superseded") else None if action in means else "unknown_action"
        want[action, means.get(action), refused] += 1
    got = {(r["action"], r["event_type"], r["refused"]): r["n"] for r in events.claim_reviews(spark, folder).collect()}
    assert got == want and sum(got.values()) == 100


def test_all_intervals_are_nested(spark, folder):
    hooks = {"purchase": "Stop", "signup": "SessionStart"}
    got = {r["session_id"]: (r["n_intervals"], r["detail"]) for r in views.nested_detail(spark, folder).collect()}
    for user in range(4):
        kinds = [KINDS[i % 3 + 1] for i in range(user, 100, 4)]
        assert got[str(user)] == (25, ";".join(f"{k}={hooks.get(kind, 'UserPromptSubmit')}" for k, kind in enumerate(kinds)))


def ordered(text):
    return [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text.lower()) for i in range(len(w) + 1)]


def windows(query, text):
    q, g = set(ordered(query)), ordered(text)
    return max((len(q & set(g[i:j])) / len(q | set(g[i:j])) for i in range(len(g)) for j in range(i + 1, len(g) + 1)), default=0.0)


def test_word_similarity_takes_the_best_window(spark):
    rng = random.Random(7)
    words = ["red", "reed", "green", "greed", "blue", "bluer", "tin", "tint"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(7))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "segment_id long, text string")
    asked = df.where("segment_id < 12").selectExpr("segment_id AS query_id", "text AS query")
    got = {(r["query_id"], r["segment_id"]): r["trigram"] for r in recall.trigram_hits(df, asked).collect()}
    want = {(a, b): s for a in range(12) for b in texts if texts[a] and (s := windows(texts[a], texts[b])) >= 0.3}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fusion_has_fifty_vector_candidates(spark, tmp_path):
    """Query 0 meets titles 1 to 20 by trigrams; their vectors rank 21 to 40, after those of unlike titles."""
    rows = [(0, "amber lamp", "")] + [(i, f"amber lamp shade{i}" if i <= 20 else f"zzz{i}", "") for i in range(1, 41)]
    near = [(0, [1.0] + [0.0] * 63)] + [(i, [1.0, (0.02 * i if i > 20 else 1 + 0.02 * i)] + [0.0] * 62) for i in range(1, 41)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"file://{tmp_path}/part.parquet")
    spark.createDataFrame(near, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    hits = {r["segment_id"]: r["score"] for r in retrieval.hybrid_recall(spark, f"file://{tmp_path}").where("query_id = 0 AND segment_id > 0").collect()}
    assert len(hits) == 10
    for i, score in hits.items():
        y = near[i][1][1]
        assert i <= 20 and score == pytest.approx(1 + 0.35 * windows("amber lamp", rows[i][1]) + 0.75 / (1 + y * y) ** 0.5, abs=1e-5)


def copies(spark, n, kinds=7):
    """``n`` titles of few texts, some of them null; every fifth id is a query."""
    texts = ["red tin", "reed tint", "green tin", "red red", "tin", "", None, "bluer greed", "tint red"][:kinds]
    rows = [(i, texts[i * i % kinds]) for i in range(n)]
    df = spark.createDataFrame(rows, "segment_id long, text string")
    return rows, df, df.where("segment_id % 5 = 0").selectExpr("segment_id AS query_id", "text AS query")


def test_copies_are_scored_once_and_all_listed(spark, monkeypatch):
    rows, df, asked = copies(spark, 400, 9)
    scored = []
    monkeypatch.setattr(recall, "trigram_scores", lambda pairs, *more, f=recall.trigram_scores: scored.append(pairs) or f(pairs, *more))
    hits = recall.top(recall.trigram_hits(df, asked, 10), 10, [F.col("trigram").desc(), "segment_id"])
    got = defaultdict(list)
    for r in hits.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["segment_id"])
    score = {(a, b): windows(a, b) for _, a in rows if a for _, b in rows if b}
    for q, a in rows[::5]:
        want = sorted((-score[a, b], s) for s, b in rows if a and b and s != q and score[a, b] >= 0.3)[:10]
        assert got[q] == [s for _, s in want]
    assert scored[0].count() <= 81


def test_ties_to_nine_digits_go_by_the_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 3e-5]), (2, [1.0, 1e-5]), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    pick = lambda k, **more: [(r["vec_id"], r["score"]) for r in recall.knn(df, df.where("vec_id = 0"), k, 2, **more).orderBy("rank").collect()]
    assert pick(1) == [(1, 1.0)] and pick(9) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 0.0), (5, 0.0)]
    assert pick(2, own=True) == [(0, 1.0), (1, 1.0)]


def test_blocks_of_vectors_keep_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK", 16)  # many blocks a task
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    got = defaultdict(list)
    for r in recall.knn(df, df.where("vec_id % 7 = 0"), 5, 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    size = {i: sum(x * x for x in v) ** 0.5 for i, v in rows}
    for q, a in rows[::7]:
        want = sorted((-max(0.0, round(sum(x * y for x, y in zip(a, b, strict=True)) / size[q] / size[s], 9)), s) for s, b in rows if s != q and size[q] and size[s])[:5]
        assert got[q] == [(s, pytest.approx(-x)) for x, s in want]


def test_equal_titles_are_embedded_once(spark, tmp_path, monkeypatch):
    names = ["aab", "bba", "abc", "a", "zz", "aabb"]
    rows = [(i, names[i * i % 6], "x" * (i % 2), "") for i in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, more string").write.parquet(f"file://{tmp_path}/part.parquet")
    sides = []
    monkeypatch.setattr(recall, "knn", lambda *given, f=recall.knn, **more: sides.append(given[:2]) or f(*given, **more))
    got = defaultdict(list)
    for r in retrieval.embedded_queries(spark, f"file://{tmp_path}").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    vector = {i: Counter((n + t)) for i, n, t, _ in rows}
    cosine = lambda a, b: round(sum(a[c] * b[c] for c in a) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5, 9)
    for q in range(0, 600, 50):
        assert got[q] == [s for _, s in sorted((-cosine(vector[q], vector[s]), s) for s in vector if s != q)[:5]]
    assert all(side.count() <= 12 for side in sides[0])


def test_copies_are_fused_once(spark, monkeypatch):
    rows, df, asked = copies(spark, 300, 9)
    rng = random.Random(5)
    near = {(q, s): rng.choice([0.1, 0.2, 0.4, 0.9]) for q in [*range(0, 300, 5), 999] for s in rng.sample(range(310), 6)}
    vector = spark.createDataFrame([(*k, v) for k, v in near.items()], "query_id long, segment_id long, vector double")
    same = lambda texts, wanted: texts.join(wanted, F.col("text") == F.col("query")).selectExpr("query_id", "segment_id", "0.5D AS lexical").where("text <> ''")
    scored = []
    monkeypatch.setattr(recall, "trigram_scores", lambda pairs, *more, f=recall.trigram_scores: scored.append(pairs) or f(pairs, *more))
    hits = recall.top(recall.hybrid(df, asked, same, vector, 10), 10, [F.round("score", 6).desc(), "segment_id"])
    got = defaultdict(list)
    for r in hits.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["segment_id"], round(r["score"], 6)))
    text = dict(rows)
    score = {(a, b): windows(a, b) for a in set(text.values()) if a for b in set(text.values()) if b}
    for q in [*range(0, 300, 5), 999]:
        want = []
        for s in range(310):
            a, b = text.get(q), text.get(s)
            exact, v = score.get((a, b), 0.0), near.get((q, s))
            if exact >= 0.3 or v is not None:
                want.append((-round(0.5 * (a == b and bool(a)) + 0.35 * exact + 0.75 * (v or 0.0), 6), s))
        assert got[q] == [(s, -x) for x, s in sorted(want)[:10]], q
    assert [x.count() <= 81 for x in scored] == [True, True]
