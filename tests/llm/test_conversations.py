"""Conversation repair against all edit sequences of small conversations, and giant ones through temporary files."""

import hashlib
import itertools
import random
import re
import zlib

from sessionloom.llm import conversations

from ..conftest import SMALL

COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def cheapest(turns):
    """(cost, audit, repaired) over all edit sequences with at most three inserts beside each turn. ``turns``: (role, text, fault)."""
    best = None
    gaps = [""] + ["I" * k for k in (1, 2)]
    for edits in itertools.product("KRD", repeat=len(turns)):
        if any(e != "D" and t[2] in ("blank", "duplicate") for e, t in zip(edits, turns, strict=True)):
            continue
        for fill in itertools.product(gaps, repeat=len(turns) + 1):
            audit = fill[0] + "".join(e + g for e, g in zip(edits, fill[1:], strict=True))
            cost = sum(COST[c] for c in audit) + 3 * sum(e != "D" and t[2] == "truncated" for e, t in zip(edits, turns, strict=True))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            rest, said, expect = iter(turns), [], None
            for e in audit:
                role, text, _ = ("", "", "") if e == "I" else next(rest)
                if e == "D":
                    continue
                if e in "IR":
                    role = {"u": "assistant"}.get(said[-1][0][:1] if said else "", "user")
                said.append((role, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in said)
    return best


def expected(rows):
    """The contract's row of one conversation by plain reading."""
    def one(x):
        return " " if x is None else str(x)

    kept = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind in (0, 1) else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns = set(), []
    for _, role, text in kept:
        shown = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault))
    count = lambda x: sum(t[2] == x for t in turns)
    numbers = [t for t, _, _ in kept if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, text = cheapest(turns)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (rows[0][0], gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repair_equals_all_edit_sequences(spark):
    draw = random.Random(5)
    table = []
    for conv in [*range(150), None]:
        for k in range(draw.randint(1, 5)):
            role = draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = draw.choice(["Yes.", "No!", "cut off", " \n\x0b", "", None, "Ça va ? ", "é ", "Yes."])
            table.append((conv, draw.choice([k, k, k + 3, None]) if conv is None or conv % 3 else k, role, text))
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "conv_id")
    got = {tuple(r) for r in conversations.repair_report(frame).collect()}
    want = {expected([r for r in table if r[0] == conv]) for conv in {r[0] for r in table}}
    assert got == want


def test_given_table_and_turns_agree(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    report = {r["conv_id"]: r for r in conversations.repair_report(table).collect()}
    assert len(report) == table.select("conv_id").distinct().count()
    said = {}
    for r in conversations.repair_turns(conversations.damage(table)).orderBy("conv_id", "position").collect():
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, r in report.items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == r["repaired_sha256"]


def test_giant_conversation_through_files(spark):
    """Every store spills at a few bytes; the result is that of the stores in memory, over several Arrow batches."""
    rows = spark.range(30_000).selectExpr("id % 2 as conv_id", "id as turn", "array('user','assistant','tool')[pmod(hash(id), 3)] as role", "concat('t', pmod(hash(id, 1), 9000), array('.', '')[pmod(hash(id, 2), 2)]) as text")
    small = {tuple(r) for r in conversations.repair_report(rows, held=600).collect()}
    assert small == {tuple(r) for r in conversations.repair_report(rows).collect()}
    assert len(small) == 2 and all(r[3] > 1000 for r in small)


def test_stores(tmp_path):
    seen, met = conversations.Seen(held=256), set()
    draw = random.Random(1)
    for _ in range(3000):
        digest = hashlib.blake2b(str(draw.randint(0, 900)).encode(), digest_size=16).digest()
        assert seen.add(digest) == (digest not in met)
        met.add(digest)
    pointers = conversations.Pointers(held=7)
    for k in range(100):
        pointers.append(k)
    assert list(reversed(pointers)) == list(range(99, -1, -1))
    program = conversations.Program()
    for state in range(200):
        if state < len(program.values):
            for code in range(12):
                program.step(state, code)
    assert len(program.values) < 200 and len(program.moves) < 256  # so a backpointer is one byte


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, kind string, times int, held string"
    assert conversations.repair_report(spark.createDataFrame([], schema)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    long = "word " * 400_000 + "."
    rows = [(dropped, 0, "user", "Gone.", "x", 9, "y"), (-5, 1, "user", long, "x", 9, "y")]
    got = {r["conv_id"]: r for r in conversations.repair_report(spark.createDataFrame(rows, schema)).collect()}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert tuple(got[-5])[6:8] in ((3, "KI"), (4, "D"), (6, "KI"))
