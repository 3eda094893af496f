"""Repair of conversation structure by the cheapest edits, streamed in order of turns.

Rows are dealt out by conversation and sorted by turn inside each partition (secondary sort); a task then reads its
partition batch by batch and carries the dynamic program across batches (``mapInArrow``: ``mapInPandas`` without the
copy into pandas, so nullable integers stay exact). What a conversation of any length holds in memory is bounded:

* the program's state is the cost of being in each of four places of the grammar ``(s?(ua)+)?``: nothing said yet,
  after the system turn, after a user turn, after an assistant turn;
* backpointers are one byte a row; beyond ``HELD`` bytes they go to a temporary file of the task and are walked back
  in blocks;
* digests of turns already seen, and the turns themselves, which are edited when the program has ended, go to such files too.

Edits: Keep is free, Rerole costs 3, Delete 4, Insert of an empty user or assistant turn 3, an undeleted truncated turn 3 more.
Blank and repeated turns must be deleted. Of the cheapest edit sequences the one whose initials sort first is
taken. That order is kept during the traversal: the sequences of the four places are compared when they meet, and of
each pair one never begins with the other at the same cost, so ranks and the last inserts are all that has to be
known. States with equal cost differences and ranks are one state, so the program is a small automaton that is built as
it is met.

Defined cases: a null role or text is one space (so a null text is blank); a null turn sorts first and a null conversation
is a conversation; rows of one turn are ordered by role and text; a conversation without rows left has zeros, an
empty audit and the hash of the empty string; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that each store of a conversation holds in memory before it goes to a temporary file.
HELD = 8 << 20
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places of the grammar: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = {"s": 0, "u": 1, "a": 2}
#: Where a kept turn of that initial leads, by the place before it.
KEPT = ({NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
SPOKEN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def damage(table: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text and ``times``, 0 for a dropped row and 2 for a repeated one."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = table.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


class Spool:
    """Objects in order; beyond ``held`` bytes they go to a temporary file in chunks."""

    def __init__(self, held: int = HELD):
        self.held, self.size, self.rows, self.file = held, 0, [], None

    def append(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size
        if self.size > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
        yield from self.rows


class Pointers:
    """Bytes that are appended and read back from the last to the first."""

    def __init__(self, held: int = HELD):
        self.held, self.bytes, self.file = held, bytearray(), None

    def append(self, value: int) -> None:
        self.bytes.append(value)
        if len(self.bytes) > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.bytes)
            self.bytes = bytearray()

    def __reversed__(self) -> Iterator[int]:
        yield from reversed(self.bytes)
        at = self.file.tell() if self.file else 0
        while at:
            start = max(0, at - self.held)
            self.file.seek(start)
            yield from reversed(self.file.read(at - start))
            at = start


class Seen:
    """Digests already met: a set, and sorted runs in temporary files that are looked up by bisection."""

    def __init__(self, held: int = HELD):
        self.most, self.young, self.runs = max(1, held // 128), set(), []

    def add(self, digest: bytes) -> bool:
        """Whether the digest is new."""
        if digest in self.young or any(self._there(run, digest) for run in self.runs):
            return False
        self.young.add(digest)
        if len(self.young) >= self.most:
            fresh = np.sort(np.frombuffer(b"".join(self.young), dtype="S16"))
            while self.runs and len(self.runs[-1]) <= len(fresh):  # runs grow in size, so there are few
                fresh = np.sort(np.concatenate([self.runs.pop(), fresh]))
            file = tempfile.TemporaryFile()
            fresh.tofile(file)
            file.flush()
            self.runs.append(np.memmap(file, dtype="S16", mode="r"))
            self.young = set()
        return True

    @staticmethod
    def _there(run: np.ndarray, digest: bytes) -> bool:
        want = np.array([digest], dtype="S16")
        at = int(np.searchsorted(run, want)[0])
        return at < len(run) and run[at] == want[0]


class Program:
    """The dynamic program as an automaton that is built as it is met.

    A state is (cost, rank, rest) of each place: the sequence of a place is a string that its rank stands for, followed by
    ``rest``. ``step`` takes a state and a turn's code to the next state and the number of its backpointers; costs
    are relative, and the least is added up by the caller.
    """

    def __init__(self):
        self.states: dict[tuple, int] = {}
        self.steps: list[dict[int, tuple[int, int, int]]] = []
        self.values: list[tuple] = []
        self.pointers: dict[tuple, int] = {}
        self.moves: list[tuple] = []
        start = [(FAR, 0, "", 0)] * 4
        start[NOTHING] = (0, 0, "", NOTHING)
        self.first, _, self.opening = self._settle(start, [""] * 4)

    def _settle(self, places: list[tuple], letters: list[str]) -> tuple[int, int, int]:
        """Inserts are free to follow; then costs are made relative and ranks small. ``places``: (cost, rank, rest, came from)."""
        places, letters = list(places), list(letters)
        for _ in range(3):
            for before, after in SPOKEN.items():
                cost, rank, rest, origin = places[before]
                offer = (cost + INSERT, rank, rest + "I", origin)
                if cost < FAR and offer[:3] < places[after][:3]:
                    places[after], letters[after] = offer, letters[before] + "I"
        # a place that another one reaches at no more cost, whatever follows, is given up
        if places[NOTHING][0] > places[ASSISTANT][0] + DELETE:
            places[NOTHING] = (FAR, 0, "", 0)
        if places[SYSTEM][0] > places[ASSISTANT][0]:
            places[SYSTEM] = (FAR, 0, "", 0)
        least = min(p[0] for p in places)
        ranks: dict[tuple, tuple[int, str]] = {}
        root = None
        for rank, rest in sorted({p[1:3] for p in places if p[0] < FAR}):
            if root is None or root[0] != rank or not rest.startswith(root[1]):
                root = (rank, rest)
                number = len({r for r, _ in ranks.values()})
            ranks[rank, rest] = (number, rest[len(root[1]) :])
        value = tuple((p[0] - least, *ranks[p[1:3]]) if p[0] < FAR else (FAR, 0, "") for p in places)
        moves = tuple((p[3], x) if p[0] < FAR else None for p, x in zip(places, letters, strict=True))
        if value not in self.states:
            self.states[value] = len(self.values)
            self.values.append(value)
            self.steps.append({})
        if moves not in self.pointers:
            self.pointers[moves] = len(self.moves)
            self.moves.append(moves)
        return self.states[value], least, self.pointers[moves]

    def step(self, state: int, code: int) -> tuple[int, int, int]:
        """(next state, cost, backpointers) for a turn's code: its initial times 3, and 0, 1 if truncated, 2 if it must go."""
        if code not in self.steps[state]:
            initial, fault = divmod(code, 3)
            places: list[tuple] = [(FAR, 0, "", 0)] * 4
            letters = [""] * 4
            for place, (cost, rank, rest) in enumerate(self.values[state]):
                if cost == FAR:
                    continue
                offers = [(place, DELETE, "D")]
                if fault < 2:
                    more = TRUNCATED * fault
                    offers.append((SPOKEN[place], RE_ROLE + more, "R"))
                    if place in KEPT[initial]:
                        offers.append((KEPT[initial][place], more, "K"))
                for to, price, letter in offers:
                    offer = (cost + price, rank, rest + letter, place)
                    if offer[:3] < places[to][:3]:
                        places[to], letters[to] = offer, letter
            self.steps[state][code] = self._settle(places, letters)
        return self.steps[state][code]

    def end(self, state: int) -> tuple[int, int]:
        """(place, cost) where the cheapest and first sequence ends."""
        value = self.values[state]
        place = min((NOTHING, ASSISTANT), key=lambda p: value[p])
        return place, value[place][0]


class Conversation:
    """One conversation as its turns come in: counts, the program's state and what has to be read again at the end."""

    def __init__(self, conv_id, program: Program, held: int = HELD):
        self.conv_id, self.program = conv_id, program
        self.state, self.cost = program.first, 0
        self.pointers, self.turns, self.seen = Pointers(held), Spool(held), Seen(held)
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.last_turn = self.last_initial = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.least = turn if self.least is None else self.least
            self.most, self.last_turn, self.distinct = turn, turn, self.distinct + 1
        said = text.encode(errors="surrogatepass")
        fresh = self.seen.add(hashlib.blake2b(b"%d:%s:%s" % (len(role), role.encode(errors="surrogatepass"), said), digest_size=16).digest())
        fault = 1 if blank else 2 if not fresh else 3 if truncated else 0
        if fault:
            self.counts[FAULTS[fault]] += 1
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last_initial = initial
        self.state, cost, pointer = self.program.step(self.state, INITIALS.get(initial, 3) * 3 + (2 if fault in (1, 2) else fault == 3))
        self.cost += cost
        self.pointers.append(pointer)
        self.turns.append((turn, role, text), len(said) + 200)

    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.distinct, (1 << 63) - 1)

    def audit(self) -> tuple[int, str]:
        """Cost and initials of the cheapest edits."""
        place, more = self.program.end(self.state)
        found = bytearray()
        for pointer in reversed(self.pointers):
            place, letters = self.program.moves[pointer][place]
            found += letters[::-1].encode()
        found += self.program.moves[self.program.opening][place][1][::-1].encode()
        found.reverse()
        return self.cost + more, found.decode()

    def repaired(self, audit: str) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) of the repaired turns in order; inserted ones have no turn."""
        turns, expect = iter(self.turns), "user"
        for edit in audit:
            turn, role, text = (None, "", "") if edit == "I" else next(turns)
            if edit == "D":
                continue
            if edit in "IR":
                role = expect
            yield edit, turn, role, text
            expect = "assistant" if role[:1] == "u" else "user"


def _streamed(rows: DataFrame, finish: Callable[[Conversation], Iterator[tuple]], schema: T.StructType, held: int) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, times) by conversation and turn; ``finish`` gives a finished conversation's result rows."""
    shown = "[^\\x20\\x09-\\x0D]"
    last = F.regexp_extract("text", f"({shown})[\\x20\\x09-\\x0D]*\\z", 1)
    flagged = rows.select("conv_id", "turn", "role", "text", F.col("times").cast("int").alias("times"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    ordered = flagged.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    arrow = to_arrow_schema(schema)

    def packed(results: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in results:
            out.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, str))
            if size > held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        program, now = Program(), None
        for batch in batches:
            for conv_id, turn, role, text, times, blank, truncated in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield from finish(now)
                    now = Conversation(conv_id, program, held)
                for _ in range(times):
                    now.add(turn, role, text, blank, truncated)
        if now is not None:
            yield from finish(now)

    return ordered.mapInArrow(lambda batches: packed(results(batches)), schema)


def repair_turns(rows: DataFrame, held: int = HELD) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (K, R or I), turn, role, text. Rows are conv_id, turn, role and text;
    a column ``times`` may say how often a row stands."""
    rows = rows if "times" in rows.columns else rows.withColumn("times", F.lit(1))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    schema = T.StructType().add("conv_id", kinds["conv_id"]).add("position", "long").add("edit", "string").add("turn", kinds["turn"]).add("role", "string").add("text", "string")

    def finish(c: Conversation) -> Iterator[tuple]:
        for position, turn in enumerate(c.repaired(c.audit()[1])):
            yield c.conv_id, position, *turn

    return _streamed(rows, finish, schema, held)


def repair_report(table: DataFrame, held: int = HELD) -> DataFrame:
    """The contract's columns for the damaged table, one row per original conversation."""
    rows = damage(table)
    schema = T.StructType().add("conv_id", rows.schema["conv_id"].dataType)
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")

    def finish(c: Conversation) -> Iterator[tuple]:
        cost, audit = c.audit()
        digest = hashlib.sha256()
        for k, (_, _, role, text) in enumerate(c.repaired(audit)):
            digest.update(f"{chr(10) if k else ''}{role}:{text}".encode(errors="surrogatepass"))
        yield c.conv_id, c.gaps(), *c.counts.values(), cost, audit, digest.hexdigest()

    return _streamed(rows, finish, schema, held)
