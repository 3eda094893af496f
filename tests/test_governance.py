"""Decisions on claims: literals for codes and attributes, redirects against taking the actions one after the other."""

import random
from datetime import datetime, timedelta

from sessionloom.operators import governance
from sessionloom.plans import governance as plans

from .conftest import SMALL

START = datetime(2024, 1, 1, 12, 0, 0, 123000)
ACTIONS = "action_id long, workspace_id string, claim_key long, action string, decided_at timestamp, reason string, title string, targets array<long>"
CLAIMS = "workspace_id string, claim_key long, state string, claim_text string, kind string, confidence double, attributes map<string,string>"


def _claims(spark, keys, state="supported", workspaces=("a",)):
    return spark.createDataFrame([(w, k, state, f"text {k}", "preference", 0.5, {"reviewNote": "n"}) for w in workspaces for k in keys], CLAIMS)


def one_by_one(rows):
    """(ends of the redirected claims, codes of the refused actions), by a plain loop over the accepted actions."""
    heir, shares, refused = {}, {}, {}

    def end(node):
        hops = 0
        while node in heir:
            node, hops = heir[node], hops + 1
        return node, hops

    for r in sorted(rows, key=lambda r: (r["decided_at"], r["action_id"])):
        if r["code"] or r["action"] not in governance.REDIRECTING or not r["targets"]:
            continue
        node, to = (r["workspace_id"], r["claim_key"]), (r["workspace_id"], r["targets"][0])
        if node in heir:
            refused[r["action_id"]] = "redirected_claim"
        elif end(to)[0] == node:
            refused[r["action_id"]] = "cyclic_target"
        else:
            heir[node], shares[node] = to, r["targets"]
    ends = {n: (end(n)[0][1], end(n)[1], sorted({end((n[0], t))[0][1] for t in shares[n]})) for n in heir}
    return ends, refused


def _same(checked):
    rows = [r.asDict() for r in checked.select("action_id", "workspace_id", "claim_key", "action", "decided_at", "targets", "code").collect()]
    led, refused = governance.redirects(checked)
    want_ends, want_refused = one_by_one(rows)
    assert {(r.workspace_id, r.claim_key): (r.live_key, r.hops, r.live_targets) for r in led.collect()} == want_ends
    got = [(r.action_id, r.code) for r in refused.collect()]
    assert len(got) == len(want_refused) and dict(got) == want_refused
    return want_ends, want_refused


def test_codes_and_attributes(spark):
    claims = _claims(spark, [1, 2, 3]).unionByName(_claims(spark, [4], "rejected"))
    at = START
    rows = [
        (1, "a", 1, "merge", at, "same thing", None, [2, 2, None]),
        (2, "a", 4, "promote", at, None, "t", None),
        (3, "a", 1, "promote", at, None, " \n", None),
        (4, "a", 9, "decay", at, None, None, None),
        (5, "b", 1, "decay", at, None, None, None),
        (6, "a", 1, "noop", at, None, None, None),
        (7, "a", 1, "decay", None, None, None, None),
        (8, "a", 2, "split", at, None, None, [3, 2]),
        (9, "a", 2, "supersede", at, None, None, [3, 77]),
        (10, "a", 4, "decay", at, None, None, []),
        (11, "a", None, "decay", at, None, None, []),
        (12, "a", 1, None, at, None, None, []),
    ]
    checked = governance.checked(spark.createDataFrame(rows, ACTIONS), claims)
    codes = {r.action_id: r.code for r in checked.collect()}
    assert codes == {1: None, 2: "terminal_claim", 3: None, 4: "unknown_claim", 5: "unknown_claim", 6: "unknown_action", 7: "bad_time", 8: "self_target", 9: "unknown_target", 10: None, 11: "unknown_claim", 12: "unknown_action"}
    events = {r.action_id: r for r in governance.decision_events(checked).collect()}
    assert sorted(events) == [1, 3, 10]
    assert events[1].attributes == {"reviewNote": "n", "maintenanceLastAction": "merged", "maintenanceLastAt": "2024-01-01T12:00:00.123Z", "maintenanceReason": "same thing", "maintenanceTargetClaimKeys": "2"}
    assert (events[1].event_type, events[1].kind, events[1].evidence_type, events[1].previous_state) == ("merged", "preference", "claim.maintenance", "supported")
    assert events[3].attributes == {"reviewNote": "n", "adrPromoted": "true", "adrPromotedAt": "2024-01-01T12:00:00.123Z", "adrTitle": "text 1"}
    assert (events[3].kind, events[3].quote) == ("decision", "Promoted to decision record: text 1")
    assert events[10].attributes == {"reviewNote": "n", "maintenanceLastAction": "decayed", "maintenanceLastAt": "2024-01-01T12:00:00.123Z"}


def _moves(spark, moves):
    """Checked actions from (claim, targets) in order of time."""
    keys = sorted({k for c, ts in moves for k in (c, *ts)})
    rows = [(i, "a", c, "split" if len(ts) > 1 else "merge", START + timedelta(seconds=i), None, None, list(ts)) for i, (c, ts) in enumerate(moves)]
    return governance.checked(spark.createDataFrame(rows, ACTIONS), _claims(spark, keys))


def test_chains_and_cycles(spark):
    ends, refused = _same(_moves(spark, [(i, [i + 1]) for i in range(1, 40)]))
    assert ends["a", 1] == (40, 39, [40]) and not refused
    # the newest action of a cycle is refused, again and again; another heir is taken later
    ends, refused = _same(_moves(spark, [(1, [2]), (2, [3]), (3, [1]), (3, [2]), (3, [1]), (3, [4]), (1, [4]), (4, [3])]))
    assert refused == {2: "cyclic_target", 3: "cyclic_target", 4: "cyclic_target", 6: "redirected_claim", 7: "cyclic_target"}
    assert ends["a", 1] == (4, 3, [4])
    # both targets of a split are followed
    ends, _ = _same(_moves(spark, [(1, [2, 3]), (3, [4]), (2, [5])]))
    assert ends["a", 1] == (5, 2, [4, 5])


def test_redirects_at_random(spark):
    rng = random.Random(5)
    for n, count in ((4, 40), (25, 120)):
        moves = [(c, [t for t in rng.sample(range(n), rng.choice((1, 1, 2))) if t != c]) for c in (rng.randrange(n) for _ in range(count))]
        _same(_moves(spark, [m for m in moves if m[1]]))


def test_redirects_of_nothing(spark):
    led, refused = governance.redirects(_moves(spark, [(1, [2])]).limit(0))
    assert led.count() == 0 and refused.count() == 0


def test_query_against_the_loop(spark):
    ends, refused = _same(plans._checked(spark, SMALL))
    assert plans.claim_redirects(spark, SMALL).count() == len(ends) + len(refused) > 0
    assert set(refused.values()) == {"cyclic_target", "redirected_claim"}
