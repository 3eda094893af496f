"""Block search against a plain search of every text, with many blocks and ids that come twice."""

import random
from collections import defaultdict

import duckdb
import pytest

from sessionloom.functions import analysis
from sessionloom.operators import recall, search, websearch
from sessionloom.plans import retrieval, stemmed

from .conftest import same_rows
from .test_segments import analyzed, plain_rank

WORDS = "alpha beta gamma delta the eps zeta".split()
QUERIES = ["alpha beta", '"alpha beta" gamma', "alpha -delta", 'alpha OR "beta gamma" -eps', "-alpha", "or or", "alpha alpha", '"alpha alpha" alpha', 'eps "the delta"', "Alpha-Beta or GAMMA delta", "", None, "the of", 'beta "gamma beta" beta -"delta eps"', "absent alpha", "alpha -absent"]


@pytest.fixture
def drawn(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 400)
    monkeypatch.setattr(search, "PACK", 5)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 16))) for _ in range(150)] + [None, ""]
    return texts, spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string"), spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def firsts(rows, limit):
    got = defaultdict(list)
    for r in rows.collect():
        got[r["query_id"]].append((-r["lexical"], r["segment_id"]))
    return {q: sorted(x)[:limit] for q, x in got.items()}


def test_blocks_find_what_a_plain_search_finds(drawn):
    texts, docs, asked = drawn
    found = websearch.first_matches(docs, asked, 4)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan  # no postings meet by a shuffle
    want = {}
    for q, query in enumerate(QUERIES):
        ranks = [(-int(r * 1e6 + 0.5) / 1e6, s) for s, text in enumerate(texts) if (r := plain_rank(query or "", text or "")) is not None]
        if ranks:
            want[q] = sorted(ranks)[:4]
    assert firsts(found, 4) == want
    blocks = sum(len(t or "") for t in texts) // 400 + 1
    assert blocks > 8 and found.count() <= 4 * blocks * len(QUERIES)


def test_blocks_find_stems_and_gaps(drawn, spark):
    texts = ["He runs daily", "the state of the art", "the state of art", "state art", "Running, state is art", "art of the state", None, ""]
    queries = ["running", '"state of art"', "runs -daily", '"the art"', "of the", 'states OR "run daily"', None]
    docs = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    english = analysis.analyzer()
    assert firsts(websearch.first_matches(docs, asked, 9, analyze=english), 9) == firsts(websearch.matches(docs, asked, analyze=english), 9)


def test_required_and_excluded_terms(drawn, spark):
    texts, docs, _ = drawn
    rows = [(0, ["alpha", "beta"], ["delta"]), (1, ["alpha", "alpha"], []), (2, ["gamma", None], []), (3, [], ["alpha"]), (4, ["zeta", "eps", "beta"], [None]), (5, ["zeta"], None), (6, None, ["x"]), (0, ["eps"], ["alpha"])]
    asked = spark.createDataFrame(rows, "query_id long, required array<string>, excluded array<string>")
    twice = docs.union(docs.where("segment_id < 20"))
    want = defaultdict(list)
    for q, required, excluded in rows:
        for s, text in [*enumerate(texts), *enumerate(texts[:20])]:
            a, need = analyzed(text or ""), set(required or [])
            if need and need <= set(a) and not set(excluded or []) & set(a):
                least = min(j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if need <= set(a[i:j]))
                want[q].append((-1 / least, s))
    assert firsts(recall.lexical_hits(twice, asked, 6), 6) == {q: sorted(x)[:6] for q, x in want.items()}


def test_long_talks_whose_segment_ids_meet(spark, tmp_path):
    """Turn 100 of a talk has the id of the next talk's first turn."""
    rng = random.Random(9)
    talk = lambda: " ".join(rng.choice(WORDS) for _ in range(12))
    rows = [(c, t, "user" if t % 2 else "assistant", talk()) for c in (0, 1, 2, 49, 50, 51, 100) for t in range(130 if c in (0, 50) else 5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    for name, row in {"customer": "1L c_custkey, 'c' c_name, 2L c_nationkey", "nation": "2L n_nationkey, 'n' n_name", "documents": "1L doc_id, 's' source"}.items():
        spark.sql(f"SELECT {row}").coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("conversations", "customer", "nation", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("lexical_recall", "recall_groups", "web_recall", "recall_metadata"):
        same_rows(retrieval.QUERIES[name](spark, f"file://{tmp_path}"), con, retrieval.ORACLES[name])


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([(1, "alpha")], "segment_id long, text string"), spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert websearch.first_matches(docs.limit(0), asked, 3).count() == 0 and websearch.first_matches(docs, asked.limit(0), 3).count() == 0
    assert [tuple(r) for r in websearch.first_matches(docs, asked, 3).collect()] == [(1, 1, 1.0)]


def test_forms_of_terms(spark):
    english = analysis.analyzer()
    texts = spark.createDataFrame([("Running runs",), ("the run, ran",), (None,)], "text string")
    terms = spark.createDataFrame([(1, ["run", "absent"]), (2, ["absent"])], "query_id long, shown array<string>")
    found = websearch.forms_of(texts, terms, english)
    assert {r["query_id"]: sorted(r["forms"]) for r in found.collect()} == {1: ["run", "running", "runs"]}
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")
    assert "ed|ing" in above and "ed|ing" not in below  # stems are made of distinct words, not of all


def test_stemmed_recall_joins_no_postings(spark, tmp_path):
    rng = random.Random(4)
    words = "running runs state states art daily lamps lamp".split()
    rows = [(c, t, "user", " ".join(rng.choice(words) for _ in range(14))) for c in range(0, 120, 10) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = stemmed.stemmed_recall(spark, f"file://{tmp_path}")
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    same_rows(found, con, stemmed.ORACLES["stemmed_recall"])
