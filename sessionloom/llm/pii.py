"""Personal data by patterns and by information-theoretic sanitisation, in DataFrame and SQL functions only.

Base entities (e-mail, IP address, card number, phone number) are found by pattern in whole texts. Then corpus
co-occurrence decides which further terms give them away. Contexts are windows: texts are cut at line ends and, in a
line, at the first word end after ``WINDOW`` characters. Protected entities are the four kinds and every single value
(one address, one number). A term is a word of three letters or more, or two such words with one space between. For a term t and
an entity e the point-wise mutual information log2(p(t, e) / (p(t) p(e))) is compared with the information content
of the entity, -log2 p(e): a term that reveals at least ``DISCLOSURE`` of it is a disclosing term, wherever it
stands in any text becomes a span of kind ``term``, and is generalised (or removed) like the entity. Probabilities are
counts over the windows of all texts; besides, a term must share with the entity ``KIND_SUPPORT`` or
``VALUE_SUPPORT`` windows of different wording, so that copies of one line are no evidence.

Every step is an aggregate or an equi-join on data that Spark partitions: only terms that stand beside an entity are
counted in the corpus, counts are combined before the shuffle, and the distinct terms of a text meet the disclosing
terms before any text is searched for places. Work inside a row is linear in the text: positions come from prefix sums
in two levels.

Defined cases: a null text is empty; repeated rows keep their own spans (rows are told apart by position, not by
id); ties need no order; an empty table gives an empty result; extra columns, whatever their names, are kept by
:func:`sanitize`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Share of an entity's information content that a term must reveal.
DISCLOSURE = 0.9
#: Windows of different wording that a term must share with a kind or with one value.
KIND_SUPPORT, VALUE_SUPPORT = 5, 2
#: Characters of a window, about.
WINDOW = 120

#: The contract's patterns in Java's dialect. A possessive quantifier stands where nothing that
#: follows could make it give back; \G or a look-behind holds the start to where the leftmost match must begin, so
#: that a long run of one class is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"[\p{L}]{3,}+"
_PAIR = r"(?<!\p{L})(?=(\p{L}{3,}+\x20\p{L}{3,}+))"
_SPAN = "ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>"
_PLAIN = "transform(spans, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"
#: Numbers of one block of a prefix sum, and characters of a stretch.
_BLOCK, _STRETCH = 32, 1024


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str) -> str:
    """SQL over a match ``m``: whether it is kept."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(m, '\\\\.'), p -> ltrim('0', p) rlike '^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    if kind == "card":
        luhn = (
            f"transform(array({digits}), d -> aggregate(sequence(1, greatest(length(d), 1)), 0, (a, i) -> a + "
            "transform(array(cast(substring(d, length(d) - i + 1, 1) as int)), x -> if(i % 2 = 1, x, if(x > 4, 2 * x - 9, 2 * x)))[0]))[0] % 10 = 0"
        )
        return f"(length({digits}) BETWEEN 16 AND 19 AND {luhn})"
    return "true"


def running(numbers: str, both: str = "a + x") -> str:
    """SQL: for each number of an array, all before it put together (0 for the first) by ``both`` of ``a`` and ``x``.

    Whole blocks are put together first, so the work is in proportion to the array.
    """
    inside = f"aggregate(sequence(1, {_BLOCK - 1}), h[cast(i div {_BLOCK} as int)], (a, k) -> if(k <= i % {_BLOCK}, transform(array(n[cast(i div {_BLOCK} as int) * {_BLOCK} + k - 1]), x -> {both})[0], a))"
    block = f"aggregate(sequence(0, {_BLOCK - 1}), element_at(h, -1), (a, k) -> transform(array(n[cast(j * {_BLOCK} + k as int)]), x -> {both})[0])"
    heads = f"aggregate(sequence(0, cast((size(n) - 1) div {_BLOCK} as int)), array(0), (h, j) -> if(j * {_BLOCK} + {_BLOCK} > size(n), h, array_append(h, {block})))"
    return f"transform(array({numbers}), n -> if(size(n) = 0, array(), transform(array({heads}), h -> transform(sequence(0, size(n) - 1), i -> {inside}))[0]))[0]"


def matches(text: str, pattern: str) -> str:
    """SQL of the matches of a pattern as structs (gap, m, start, end), in code points; the gap is the text before a match.

    The parts between matches and the matches themselves add up to the text, which gives the positions.
    """
    p = _quoted(pattern)
    none = "cast(array() as ARRAY<STRUCT<gap: STRING, m: STRING, start: INT, end: INT>>)"
    steps = running("transform(f.ms, (m, i) -> length(f.ps[i]) + length(m))")
    placed = f"transform(array({steps}), at -> transform(f.ms, (m, i) -> named_struct('gap', f.ps[i], 'm', m, 'start', at[i] + length(f.ps[i]), 'end', at[i] + length(f.ps[i]) + length(m))))[0]"
    return f"transform(array(regexp_extract_all({text}, {p}, 0)), ms -> if(size(ms) = 0, {none}, transform(array(named_struct('ms', ms, 'ps', split({text}, {p}, -1))), f -> {placed})[0]))[0]"


def base_spans(text: str) -> Column:
    """The kept base spans by kind as listed, then start; ``value`` is what was found, numbers without separators."""
    kinds = "ARRAY<STRUCT<kind: STRING, start: INT, end: INT, value: STRING>>"
    value = lambda k: "regexp_replace(x.m, '[^0-9]', '')" if k in ("card", "phone") else "lower(x.m)"
    found = [f"transform(filter({matches(text, p)}, x -> transform(array(x.m), m -> {_valid(k)})[0]), x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end, 'value', {value(k)}))" for k, p in PATTERNS.items()]
    # a character that every match must hold spares most texts the expression
    needs = {"email": "'@'", "phone": "'+'", "ip": "'.'"}
    guarded = [f"if(contains({text}, {needs[k]}), {x}, cast(array() as {kinds}))" if k in needs else x for k, x in zip(KINDS, found, strict=True)]
    return F.expr(f"cast(concat({', '.join(guarded)}) as {kinds})")


_WINDOWS = rf"[^\n]{{1,{WINDOW}}}[\p{{L}}\p{{N}}]*+\n?|\n"


def windows(text: str) -> str:
    """SQL of the windows of a text, which add up to it."""
    return f"regexp_extract_all({text}, {_quoted(_WINDOWS)}, 0)"


def terms(window: str) -> str:
    """SQL of the distinct terms of a window: its words and its pairs of words with one space between."""
    return f"transform(array(lower({window})), w -> array_distinct(concat(regexp_extract_all(w, {_quoted(TERM)}, 0), regexp_extract_all(w, {_quoted(_PAIR)}, 1))))[0]"


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """row (a number for each row), doc (all its columns), text and base spans; written to the shared scratch folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return materialize(rows.withColumn("spans", base_spans("text")), "entities")


def entity_windows(rows: DataFrame) -> DataFrame:
    """(w, entity) for each window that an entity touches: the entity is its kind, or its kind and value.

    Windows and spans of a text meet by row and stretch of ``_STRETCH`` characters, so a text with very many of both is no
    product of them.
    """
    some = rows.where("size(spans) > 0")
    cut = some.select("row", F.expr(windows("text")).alias("ws"))
    cut = cut.select("row", F.explode(F.expr(f"transform(array({running('transform(ws, w -> length(w))')}), at -> transform(ws, (w, i) -> named_struct('w', w, 'at', at[i])))[0]")).alias("x"))
    cut = cut.select("row", "x.w", "x.at", F.explode(F.expr(f"sequence(x.at div {_STRETCH}, (x.at + length(x.w) - 1) div {_STRETCH})")).alias("stretch"))
    spans = some.select("row", F.explode("spans").alias("s")).select("row", "s", F.explode(F.expr(f"sequence(s.start div {_STRETCH}, (s.end - 1) div {_STRETCH})")).alias("stretch"))
    met = cut.join(spans, ["row", "stretch"]).where("s.start < at + length(w) AND s.end > at")
    return met.select("row", "at", "w", F.explode(F.array("s.kind", F.concat_ws(" ", "s.kind", "s.value"))).alias("entity")).distinct()


def disclosing_terms(rows: DataFrame, disclosure: float = DISCLOSURE, kind_support: int = KIND_SUPPORT, value_support: int = VALUE_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(term, entity, pmi, revealed) of the pairs whose information reaches the threshold, and (row, term): the windows
    of all texts that hold a term which was tried. ``rows`` are those of :func:`numbered`."""
    held = materialize(entity_windows(rows), "windows")
    sizes = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    together = held.select("entity", F.xxhash64("w").alias("wording"), F.explode(F.expr(terms("w"))).alias("term")).groupBy("term", "entity").agg(F.count("*").alias("both"), F.countDistinct("wording").alias("wordings"))
    least = F.when(F.instr("entity", " ") > 0, value_support).otherwise(kind_support)
    together = materialize(together.where(F.col("wordings") >= least), "together")  # its size is known to the joins
    every = rows.select("row", F.explode(F.expr(windows("text"))).alias("w")).select("row", F.explode(F.expr(terms("w"))).alias("term"))
    hits = materialize(every.join(together.select("term").distinct(), "term", "left_semi").select("row", "term"), "hits")
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(_WINDOWS))).cast("double").alias("n"))
    alone = hits.groupBy("term").agg(F.count("*").alias("n_term"))
    found = together.join(alone, "term").join(sizes, "entity").crossJoin(F.broadcast(total))  # one row
    found = found.withColumn("pmi", F.log2(F.col("both") * F.col("n") / (F.col("n_term") * F.col("n_entity"))))
    found = found.withColumn("revealed", F.col("pmi") / F.greatest(F.log2(F.col("n") / F.col("n_entity")), F.lit(1e-9)))
    return found.where(F.col("revealed") >= disclosure).select("term", "entity", "pmi", "revealed"), hits


def term_spans(text: str, held: str) -> str:
    """SQL of the places of the terms ``held`` in a text, as spans by start; of two that overlap the first stays."""
    return (
        f"transform(array({matches(text, TERM)}), ms -> filter(transform(ms, (x, i) -> named_struct('start', x.start, 'end', "
        f"CASE WHEN get(ms, i + 1).gap = ' ' AND array_contains({held}, concat(lower(x.m), ' ', lower(get(ms, i + 1).m))) THEN get(ms, i + 1).end WHEN array_contains({held}, lower(x.m)) THEN x.end END, 'kind', 'term')), s -> s.end IS NOT NULL))[0]"
    )


def free_terms(spans: str, found: str) -> str:
    """SQL of the term spans that touch no base span (a part of an address is covered already) and no earlier term."""
    every = f"array_sort(concat(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)), {found}))"
    before = running("transform(s, x -> if(x.kind = 'term', 0, x.end))", "greatest(a, x)")
    behind = running("transform(reverse(s), x -> if(x.kind = 'term', 0, 1073741824 - x.start))", "greatest(a, x)")
    clear = f"transform(array(named_struct('b', {before}, 'e', {behind})), m -> filter(s, (x, i) -> x.kind = 'term' AND m.b[i] <= x.start AND 1073741824 - m.e[size(s) - 1 - i] >= x.end))[0]"
    first = f"transform(array({running('transform(s, x -> x.end)', 'greatest(a, x)')}), m -> filter(s, (x, i) -> x.start >= m[i]))[0]"
    clear = f"transform(array({every}), s -> {clear})"
    return f"transform(transform({clear}, s -> {first})[0], s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"


def all_spans(rows: DataFrame, found: DataFrame, hits: DataFrame) -> DataFrame:
    """row, doc, base spans and ``terms``: the spans of disclosing terms, wherever they stand in any text, by start.

    ``hits`` tell which texts hold a term; only those are searched for places.
    """
    known = materialize(found.select("term").distinct(), "terms")  # its size is known to the join
    held = hits.join(known, "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("held"))
    rows = rows.join(materialize(held, "held"), "row", "left")
    return rows.withColumn("terms", F.expr(f"if(held IS NULL, cast(array() as {_SPAN}), {free_terms('spans', term_spans('text', 'held'))})"))


def sanitize(docs: DataFrame, text: str = "text", remove: bool = False, **thresholds: float) -> DataFrame:
    """``docs`` with entities replaced by ``[kind]`` and disclosing terms generalised to ``[term]`` or removed.

    Texts without either are unchanged. ``thresholds`` are those of :func:`disclosing_terms`.
    """
    rows = numbered(docs, text)
    found = all_spans(rows, *disclosing_terms(rows, **thresholds))
    shown = "if(s.kind = 'term', '', concat('[', s.kind, ']'))" if remove else "concat('[', s.kind, ']')"
    found = found.withColumn("spans", F.expr(f"array_sort(transform(concat({_PLAIN}, terms), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"))
    # parts: the text from the furthest end so far to the span, then its label; a span inside an earlier one has none
    parts = "transform(spans, (s, i) -> if(s.start < m[i], '', concat(substring(text, m[i] + 1, s.start - m[i]), {}))), array(substring(text, array_max(transform(spans, s -> s.end)) + 1))".format(shown)
    rebuilt = F.expr(f"transform(array({running('transform(spans, s -> s.end)', 'greatest(a, x)')}), m -> array_join(concat({parts}), ''))[0]")
    cleaned = F.when(F.expr("size(spans) > 0"), rebuilt).otherwise(F.col("doc").getField(text))
    return found.select(*[cleaned.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's columns and ``n_term``."""
    rows = numbered(docs.select("doc_id", "text"), "text")
    found = all_spans(rows, *disclosing_terms(rows))
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.expr(_PLAIN)
    return found.select("doc.doc_id", *[count(k) for k in KINDS], F.sha2(shown(spans), 256).alias("base_sha256"), shown(F.concat(spans, F.col("terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"))
