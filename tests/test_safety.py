"""Tables of patterns against one pattern after another, and redaction that leaves no trace in any table."""

import json
import random
import time

import pytest

from sessionloom.operators import patterns, redaction
from sessionloom.plans import safety


def in_order(text, rows):
    hits = 0
    for _, p, put, _ in rows:
        hits += text.count(p)
        text = text.replace(p, put)
    return text, hits


def test_literals_equal_replacing_in_order():
    """Short patterns over a small alphabet, so that replacements make and break later matches."""
    draw = random.Random(6)
    for _ in range(400):
        rows = [("literal", "".join(draw.choice("abc") for _ in range(draw.randint(1, 4))), draw.choice(["", "a", "bc", "cab", "x"]), "") for _ in range(draw.randint(1, 12))]
        one = patterns.Redactor(rows)
        for _ in range(5):
            text = "".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))
            assert one(text) == in_order(text, rows), (text, rows)


def test_ten_thousand_literals_in_one_pass():
    draw = random.Random(7)
    rows = [("literal", f"secret-{draw.getrandbits(48):012x}", "[k]", "") for _ in range(10_000)]
    text = "".join(draw.choice("some words of a long text ") for _ in range(2_000_000)) + rows[5][1] + " " + rows[7][1] * 3
    one = patterns.Redactor(rows)
    began = time.perf_counter()
    got = one(text)
    assert got[1] == 4 and got == in_order(text, [rows[5], rows[7]]) and time.perf_counter() - began < 5


def test_expressions_flags_and_json(spark):
    table = spark.createDataFrame([(2, "regex", "[0-9]{3}", None, ""), (1, "literal", "key", "k$1", ""), (3, "regex", "SECRET", "-", "i")], safety.TABLE)
    text, tree = patterns.redactor(table)
    rows = spark.createDataFrame([('{"key": ["a key 123", {"key123": 123, "é": "Secret"}], "z": null, "n": 1.5}',), ("no json key",), (None,), ("",)], "t string")
    got = [tuple(r) for r in rows.select("t", tree("t").alias("j"), text("t").alias("s")).select("j.text", "j.n", "s.text", "s.n").collect()]
    assert json.loads(got[0][0]) == {"k$1": ["a k$1 [REDACTED]", {"k$[REDACTED]3": 123, "é": "-"}], "z": None, "n": 1.5} and got[0][1] == 6
    assert got[1] == ("no json k$1", 1, "no json k$1", 1) and got[2] == (None, 0, None, 0) and got[3] == ("", 0, "", 0)


@pytest.mark.parametrize("row", [(1, "literal", "  ", None, ""), (1, "glob", "a", None, ""), (1, "regex", "(hush", None, ""), (1, "regex", "a", None, "q")])
def test_wrong_patterns_are_refused_without_showing_them(row):
    with pytest.raises(ValueError, match="position 1") as error:
        patterns.checked([row])
    assert "hush" not in str(error.value)
    with pytest.raises(ValueError, match="at least one"):
        patterns.checked([])


def test_no_table_keeps_a_trace(spark):
    secret = "super-secret-token"
    frame = spark.createDataFrame
    tables = {
        "snapshots": frame([("s", 1, f"old {secret}"), ("s", 2, f"a {secret} b"), ("t", 1, "clean"), ("u", 1, "[x] here"), ("u", 2, f"{secret} here"), ("v", 1, f"not chosen {secret}")], "session_id string, captured long, content string"),
        "events": frame([("w", "s", 1, f"id-{secret}", f"src-{secret}", f'{{"{secret}": ["{secret}"]}}', secret), ("w", "s", 2, "plain", "src", '{"a": 1}', None), ("w", "t", 3, "t1", "src", "{}", None), ("w", "u", 4, f"u-{secret}", "src", "{}", None)], "workspace_id string, session_id string, raw_event_id long, external_event_id string, source_id string, payload string, trace_id string"),
        "references": frame([(f"id-{secret}", "edge"), ("plain", "edge"), (f"id-{secret}", "evidence"), ("elsewhere", "edge")], "external_id string, kind string"),
        "claim_events": frame([("w", 10, 1), ("w", 10, 2), ("w", 11, 2)], "workspace_id string, claim_key long, raw_event_id long"),
        "claims": frame([("w", 10), ("w", 11)], "workspace_id string, claim_key long"),
    }
    out = redaction.redact_sessions(tables, frame([(0, "literal", secret, "[x]", "")], safety.TABLE), frame([("s",), ("t",), ("u",), ("gone",)], "session_id string"))
    assert {tuple(r) for r in out["errors"].collect()} == {("t", "no_match"), ("u", "repeated_hash"), ("gone", "no_match")}
    rest = [str(r) for k in ("snapshots", "events") for r in out[k].where("session_id = 's'").collect()] + [str(r) for r in out["references"].collect()]
    assert not any(secret in r for r in rest)
    assert sorted(r["external_id"] for r in out["references"].collect()) == ["elsewhere", "plain", "redacted:1:external-event", "redacted:1:external-event"]
    event = out["events"].where("raw_event_id = 1").first()
    assert (event["external_event_id"], event["source_id"], json.loads(event["payload"]), event["trace_id"], event["hits"]) == ("redacted:1:external-event", "redacted:1:source", {"[x]": ["[x]"]}, "[x]", 5)
    assert [r["claim_key"] for r in out["claims"].collect()] == [11]
    shots = {(r["captured"], r["content"], r["status"]) for r in out["snapshots"].where("session_id = 's'").collect()}
    assert shots == {(1, None, "redacted"), (2, None, "redacted"), (3, "a [x] b", "redacted")}
    assert out["snapshots"].where("session_id = 'u' AND status = 'captured'").count() == 2
