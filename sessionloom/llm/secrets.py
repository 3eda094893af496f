"""Secret scans over whole texts with a trigram inverted index.

Each rule's regular expression is analysed once on the driver into a Boolean query over lower-cased byte
trigrams (AND inside a literal, OR between alternatives). Every Arrow batch of documents is one block of a
document-partitioned index: the block's postings (trigram -> sorted document numbers) are built with NumPy from
the raw UTF-8 buffer, the query of each rule is answered by intersecting and uniting postings, and only the
candidates are run through the regular expression. A rule whose expression has no mandatory trigram (a run of
hexadecimal digits, for instance) scans every document of the block. A block never leaves its task, so the scan
has no shuffle, memory is bounded by the Arrow batch and a lost executor only repeats its own blocks.

Defined cases: a null text counts as empty and yields no spans; an empty table yields an empty result; repeated
rows are scanned row by row; extra columns are kept by :func:`find_secrets` and :func:`mask_secrets` (a column
that already has the name of an output column is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre  # type: ignore[no-redef]
    import sre_parse as sre_parser  # type: ignore[no-redef]


class Rule(NamedTuple):
    """``kind``; a Python pattern with ASCII classes; the least length of ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The three base kinds of the contract.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: A private key from its header to the END line. Where that is missing, to the end of the body: header fields, runs of
#: 16 base64 characters or more, and one shorter last line. Newlines may be written as escapes.
_BREAK = r"(?:\r?\n|(?:\\r)?\\n)"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*(?:-(?!----)[^-]*)*-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:[ \t]*{_BREAK}[ \t]*(?:Proc-Type|DEK-Info|Comment|Version|Charset|Hash):[^\n\\]*)*(?:(?:\s|\\[nrt])+[A-Za-z0-9+/=]{{16,}})*"
    rf"(?:[ \t]*{_BREAK}[ \t]*[A-Za-z0-9+/=]+(?=[ \t]*(?:{_BREAK}|\Z)))?)"
)
#: Published shapes of vendor credentials, added by the method.
EXTRA_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Most strings that the analysis keeps for one finite part of an expression.
FINITE = 64

Query = tuple  # ("and", parts) | ("or", parts) | ("tri", bytes) | ("all",)
ALL: Query = ("all",)


def _both(a: Query, b: Query) -> Query:
    return b if a == ALL else a if b == ALL else ("and", (a, b))


def _either(parts: list[Query]) -> Query:
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]) -> Query:
    """The trigrams that a text with one of the strings must hold."""
    found = []
    for s in sorted(strings):
        grams = [("tri", s[i : i + 3]) for i in range(len(s) - 2)]
        found.append(("and", tuple(grams)) if len(grams) > 1 else grams[0] if grams else ALL)
    return _either(found)


def _chars(items) -> set[bytes] | None:
    """The lower-cased characters of a class, or None when they are too many or not plain."""
    chars: set[bytes] = set()
    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            chars.add(chr(arg).lower().encode())
        elif op is sre.RANGE and arg[1] < 128:
            chars |= {chr(c).lower().encode() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _analyse(items) -> tuple[set[bytes] | None, Query]:
    """(all strings that the sequence can match if they are few, else None; the query that every match meets)."""
    run: set[bytes] = {b""}
    query, finite = ALL, True
    for op, arg in items:
        strings: set[bytes] | None = None
        inner = ALL
        if op is sre.LITERAL:
            strings = {chr(arg).lower().encode()} if arg < 128 else None
        elif op is sre.IN:
            strings = _chars(arg)
        elif op is sre.AT:
            strings = {b""}
        elif op is sre.SUBPATTERN:
            strings, inner = _analyse(arg[3])
        elif op is sre.BRANCH:
            branches = [_analyse(x) for x in arg[1]]
            if all(s is not None for s, _ in branches):
                strings = set().union(*(s for s, _ in branches))
            inner = _either([_both(_of_strings(s), q) if s is not None else q for s, q in branches])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            some, inner = _analyse(body)
            if low == 0:
                strings, inner = (some | {b""} if some is not None and high == 1 else None), ALL
            elif low == high == 1:
                strings = some
        joined = {a + b for a in run for b in strings} if strings is not None else None
        if joined is not None and len(joined) <= FINITE:
            run = joined
        else:
            query, finite = _both(_both(query, _of_strings(run)), inner if strings is None else _of_strings(strings)), False
            run = {b""}
    return (run, ALL) if finite else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression; ``("all",)`` when no trigram is mandatory."""
    strings, query = _analyse(sre_parser.parse(pattern))
    return _both(_of_strings(strings), query) if strings is not None else query


def trigrams_of(query: Query) -> set[bytes]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams_of(x) for x in query[1])) if query[0] in ("and", "or") else set()


_LOWER = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], dtype=np.uint8)


def block_postings(data: np.ndarray, offsets: np.ndarray, grams: list[bytes]) -> dict[bytes, np.ndarray]:
    """Postings of one block: for each wanted trigram the sorted numbers of the documents that hold it."""
    n = len(offsets) - 1
    empty = np.empty(0, dtype=np.int64)
    if not grams or len(data) < 3:
        return dict.fromkeys(grams, empty)
    table = np.zeros(1 << 24, dtype=np.uint8 if len(grams) < 255 else np.uint16)
    for k, g in enumerate(grams, 1):
        table[g[0] << 16 | g[1] << 8 | g[2]] = k
    found: list[list[np.ndarray]] = [[] for _ in grams]
    step = 1 << 22
    for at in range(0, len(data) - 2, step):
        low = _LOWER[data[at : at + step + 2]].astype(np.uint32)
        which = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        places = np.flatnonzero(which)
        docs = np.searchsorted(offsets, places + at, side="right") - 1
        inside = places + at + 3 <= offsets[np.minimum(docs + 1, n)]
        which, docs = which[places][inside].astype(np.int64) - 1, docs[inside]
        pairs = np.unique(which * n + docs)
        cuts = np.searchsorted(pairs // n, np.arange(len(grams) + 1))
        for k in range(len(grams)):
            if cuts[k] < cuts[k + 1]:
                found[k].append(pairs[cuts[k] : cuts[k + 1]] % n)
    return {g: np.unique(np.concatenate(x)) if x else empty for g, x in zip(grams, found, strict=True)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Answer a trigram query by intersecting and uniting postings."""
    kind = query[0]
    if kind == "all":
        return everything
    if kind == "tri":
        return postings[query[1]]
    parts = [candidates(x, postings, everything) for x in query[1]]
    if kind == "or":
        return np.unique(np.concatenate(parts))
    out = parts[0]
    for x in sorted(parts[1:], key=len):
        out = np.intersect1d(out, x, assume_unique=True)
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Scanner:
    """The rules with their compiled expressions and trigram queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))

    def __call__(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each document its spans (start, number of the rule, end) in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        if not len(column):
            return out
        data, offsets = text_buffers(column)
        postings = block_postings(data, offsets, self.grams)
        everything = np.flatnonzero(np.diff(offsets) > 0)
        texts = column.to_pylist()
        for k, (rule, expression, query) in enumerate(self.rules):
            for d in candidates(query, postings, everything).tolist():
                for m in expression.finditer(texts[d] or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, output: str = "secret_spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end) spans by start, then by the order of ``rules``."""
    kept = [c for c in docs.columns if c != output]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        names = [r.kind for r in rules]
        for batch in batches:
            found = scanner(batch.column(batch.schema.get_field_index(text)))
            spans = pa.array([[{"kind": names[k], "start": a, "end": b} for a, k, b in x] for x in found], type=_SPAN)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, output])

    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(output, SPAN)]))


def mask_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret (overlapping spans as one) replaced by ``mark``; other texts stay as they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(scanner(batch.column(at))):
                if not spans:
                    continue
                pieces, end = [], 0
                for a, _, b in spans:
                    if a >= end:
                        pieces += [texts[i][end:a], mark]
                    end = max(end, b)
                texts[i] = "".join([*pieces, texts[i][end:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of the contract, one row per document."""
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text").drop("text")
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secret_spans")).alias("spans"))
