"""Targets of findings against literals, and lineages kept up to date against a search of all edges."""

import random

from sessionloom.operators import dispositions, graph

EDGES = "workspace_id string, session_id long, record_id string, kind string, from_key string, to_key string, to_finding_id string"


def test_targets(spark):
    findings = spark.createDataFrame(
        [("a", 1, "r1", "k", "f1"), ("a", 1, "r1", "m", "f2"), ("a", 2, "r2", "k", "f3"), ("a", 3, "r3", "k", "f4"), ("b", 1, "r9", "k", "f9")],
        "workspace_id string, session_id long, record_id string, key string, finding_id string",
    )
    labels = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "workspace_id string, node long, lineage long")
    rows = {
        ("builds_on", "k", "m", None): ("f1", "f2", None),
        ("refutes", "k", None, "f3"): ("f1", "f3", None),
        ("builds_on", "k", None, "f4"): ("f1", "f4", "outside_lineage"),
        ("builds_on", "k", None, "f9"): ("f1", None, "unknown_target"),  # of another workspace
        ("builds_on", "k", "x", None): ("f1", None, "unknown_target"),
        ("builds_on", "x", "k", None): (None, "f1", "unknown_source"),
        ("builds_on", "k", "m", "f3"): ("f1", "f3", "target_form"),
        ("builds_on", "k", None, None): ("f1", None, "target_form"),
        ("builds_on", "k", "\n ", None): ("f1", None, "target_form"),
        ("builds_on", " ", "k", None): (None, "f1", "empty_source"),
        (None, "k", "m", None): ("f1", "f2", "bad_kind"),
        ("builds_on", "k", "k", None): ("f1", "f1", "self_edge"),
        ("builds_on", "m", None, "f2"): ("f2", "f2", "self_edge"),
    }
    for edge, want in rows.items():
        (got,) = dispositions.resolve(spark.createDataFrame([("a", 1, "r1", *edge)], EDGES), findings, labels).collect()
        assert (got.source, got.target, got.code) == want, edge
    assert dispositions.resolve(spark.createDataFrame([], EDGES), findings, labels).count() == 0


def _labels(df):
    rows = df.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.lineage for r in rows}


def _search(edges, nodes):
    label = {n: n for n in nodes}
    while True:
        now = dict(label)
        for a, b in edges:
            now[a] = now[b] = min(now[a], now[b])
        if now == label:
            return label
        label = now


def test_lineages_as_edges_come_and_go(spark):
    make = lambda e: spark.createDataFrame(sorted(e), "source long, target long")
    rng = random.Random(3)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(30)}
    edges = {(a, b) for a, b in edges if a != b}
    labels = graph.lineage(make(edges))
    nodes = {n for e in edges for n in e}
    assert _labels(labels) == _search(edges, nodes)
    for _ in range(2):
        more = {(a, b) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(12)) if a != b}
        labels = graph.stored(graph.extend_lineage(labels, make(more)), "labels")
        edges, nodes = edges | more, nodes | {n for e in more for n in e}
        assert _labels(labels) == _search(edges, nodes)
        gone = set(rng.sample(sorted(edges), 8))
        # an edge may be named from either end
        labels = graph.stored(graph.shrink_lineage(labels, make(edges), make({(b, a) for a, b in gone})), "labels")
        edges = edges - gone - {(b, a) for a, b in gone}
        assert _labels(labels) == _search(edges, nodes)
    assert _labels(graph.extend_lineage(labels, make(edges).limit(0))) == _search(edges, nodes)
