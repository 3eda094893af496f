"""Redaction by patterns that are rows of a table: literals by one automaton, regular expressions behind it.

The result and the number of replacements are those of applying the patterns one after another, in order of ``position``.
An Aho-Corasick automaton of all literals names those that a text holds, so a text meets only its own patterns. A
replacement can bring in or break a later literal only where it joins the text; so those places are searched again, and
the patterns found there that come later are applied in their turn. Regular expressions are applied to every text.

A table of patterns is sent whole to every worker; it is refused beyond ``MOST_BYTES``. Expressions are Python's.

Defined cases: a null text stays null with no replacement; patterns are trimmed, and a blank one, an unknown kind or a wrong
expression is an error that names its position, never the pattern; a null replacement is ``[REDACTED]``; in JSON, keys and
strings are redacted at every depth and of keys that become equal the last stays; a text that is no JSON is redacted as text.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
REPLACEMENT = "[REDACTED]"
_FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}


def checked(rows: list[tuple]) -> list[tuple[str, str, str, str]]:
    """(kind, pattern, replacement, flags) of valid rows (position, kind, pattern, replacement, flags) in order."""
    out = []
    for position, kind, pattern, replacement, flags in sorted(rows, key=lambda r: r[0]):
        pattern = (pattern or "").strip()
        if not pattern:
            raise ValueError(f"redaction pattern at position {position} is blank")
        if kind not in ("literal", "regex"):
            raise ValueError(f"redaction pattern at position {position} is neither literal nor regex")
        if set(flags or "") - set(_FLAGS):
            raise ValueError(f"redaction pattern at position {position} has invalid flags")
        if kind == "regex":
            try:
                re.compile(pattern)
            except re.error:
                raise ValueError(f"redaction pattern at position {position} has invalid syntax") from None
        out.append((kind, pattern, REPLACEMENT if replacement is None else replacement, flags or ""))
    if not out:
        raise ValueError("at least one redaction pattern is required")
    return out


class Redactor:
    """All patterns over one text after another."""

    def __init__(self, patterns: list[tuple[str, str, str, str]]):
        import ahocorasick

        self.patterns = patterns
        self.expressions = {i: re.compile(p, sum(_FLAGS[f] for f in set(flags))) for i, (kind, p, _, flags) in enumerate(patterns) if kind == "regex"}
        numbers: dict[str, list[int]] = {}
        for i, (kind, p, _, _) in enumerate(patterns):
            if kind == "literal":
                numbers.setdefault(p, []).append(i)
        self.longest = max(map(len, numbers), default=0)
        self.automaton = ahocorasick.Automaton()
        for p, at in numbers.items():
            self.automaton.add_word(p, tuple(at))
        if numbers:
            self.automaton.make_automaton()

    def _held(self, text: str) -> set[int]:
        return {i for _, at in self.automaton.iter(text) for i in at} if self.longest else set()

    def _joined(self, pieces: list[str], put: str) -> set[int]:
        """The literals that hold a part of a replacement: what stands around each, as far as a literal reaches."""
        reach, found = self.longest - 1, set()
        whole = put.join(pieces)
        if len(pieces) * (2 * reach + len(put)) > len(whole):
            return self._held(whole)
        end = 0
        for piece in pieces[:-1]:
            end += len(piece)
            found |= self._held(whole[max(0, end - reach) : end + len(put) + reach])
            end += len(put)
        return found

    def __call__(self, text: str | None) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        waiting = self._held(text) | self.expressions.keys()
        order, hits = [*waiting], 0
        heapq.heapify(order)
        while order:
            i = heapq.heappop(order)
            put = self.patterns[i][2]
            if i in self.expressions:
                text, n = self.expressions[i].subn(lambda _, put=put: put, text)
                fresh = self._held(text) if n else set()
            else:
                pieces = text.split(self.patterns[i][1])
                n = len(pieces) - 1
                text, fresh = (put.join(pieces), self._joined(pieces, put)) if n else (text, set())
            hits += n
            for k in fresh - waiting:
                if k > i:
                    waiting.add(k)
                    heapq.heappush(order, k)
        return text, hits

    def json(self, text: str | None) -> tuple[str | None, int]:
        """A JSON text with its keys and strings redacted, written without blanks."""
        if text is None:
            return None, 0
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return self(text)
        hits = 0

        def walk(x):
            nonlocal hits
            if isinstance(x, str):
                x, n = self(x)
                hits += n
            elif isinstance(x, list):
                x = [walk(v) for v in x]
            elif isinstance(x, dict):
                x = {walk(k): walk(v) for k, v in x.items()}
            return x

        return json.dumps(walk(value), ensure_ascii=False, separators=(",", ":")), hits


_WORKER: dict[str, Redactor] = {}


def redactor(patterns: DataFrame) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Column functions (of a text, of a JSON text) to a struct (text, n) for a table position, kind, pattern, replacement, flags."""
    picked = patterns.select("position", "kind", "pattern", "replacement", "flags")
    size = picked.agg(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("replacement"), F.lit(0)) + 64)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the pattern table has {size} bytes; {MOST_BYTES} are the most that is sent to every worker")
    shared = patterns.sparkSession.sparkContext.broadcast(checked([tuple(r) for r in picked.collect()]))
    key = uuid.uuid4().hex

    def apply(name: str):
        @F.pandas_udf("text string, n long")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            if key not in _WORKER:
                _WORKER.clear()
                _WORKER[key] = Redactor(shared.value)
            one = getattr(_WORKER[key], name)
            for texts in batches:
                yield pd.DataFrame([one(t if isinstance(t, str) else None) for t in texts], columns=["text", "n"])

        return run

    return apply("__call__"), apply("json")
