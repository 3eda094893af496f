"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions only.

A text is cut into paragraphs (lines; a long line is cut on at the next sentence end after ``PARAGRAPH``
characters), and each distinct paragraph's 64-bit digest goes into one cell of each of three sub-tables; a cell
holds a count, the XOR of its digests and the XOR of their check values. The fingerprint is that sketch as text.
Two sketches of one size subtract cell by cell; cells that hold a single digest are peeled until the sketch is
empty, which recovers the digests that only one of the texts has, and with the paragraph counts the Jaccard
likeness. Where peeling fails, both sketches are built again, larger, sized by the paragraph counts, and once more
four times as large; only two digests that share all cells at all sizes are left to a comparison of the digests.

All sketch work is inside a row. The one shuffle of texts brings each document together with its neighbour in id order:
ids are cut into ranges of about ``RANGE_ROWS`` rows at quantiles, each range is sorted, and the first document of
a range is also sent, as a guest, to the range before it. Bounds are broadcast while they are known to be few
(``BROADCAST_RANGES``, a size check that changes no result).

Defined cases: a null text is empty; two texts without paragraphs have likeness 1; equal texts have equal
fingerprints; repeated ids are ordered by text; a null id sorts below all others; a single document is its own
neighbour; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a fingerprint (three sub-tables of a third each).
CELLS = 30
#: Characters after which a long line is cut at the next sentence end.
PARAGRAPH = 150
#: Rows of a range of ids, about, and ranges of one level of quantiles.
RANGE_ROWS, LEVEL = 1500, 1024
#: Ranges whose bounds and first ids are broadcast at most (three numbers each); beyond, they are joined by a shuffle.
BROADCAST_RANGES = 500_000

_CELL = "STRUCT<n: INT, k: BIGINT, h: BIGINT>"
_CHECK = "(xxhash64({k}, 99) & 4294967295)"


def digests(text: str) -> Column:
    """The distinct paragraph digests of a text column."""
    cut = rf"[^\n]{{1,{PARAGRAPH}}}[^\n.!?]*[.!?]*"
    return F.expr(f"array_distinct(transform(regexp_extract_all(coalesce({text}, ''), '{cut}', 0), p -> xxhash64(p)))".replace("\\", "\\\\"))


def _cells(key: str, cells: str) -> str:
    """The named fields c0, c1 and c2 of a digest: its cell in each sub-table."""
    third = f"cast({cells} div 3 as int)"
    return ", ".join(f"'c{j}', {j} * {third} + cast(pmod(xxhash64({key}, {j}), {third}) as int)" for j in range(3))


def _hashed(keys: str, cells: str, n: int = 1) -> str:
    """Each digest with a sign, its check value and its cells."""
    return f"transform({keys}, d -> named_struct('n', {n}, 'k', d, 'h', {_CHECK.format(k='d')}, {_cells('d', cells)}))"


def _grouped(digests: str, cells: str, old: str, sign: str) -> str:
    """SQL of a sketch's cells after the digests went into them (sign +) or came out of them (-).

    Cells are taken in groups, about as many as a group has cells, and a group looks at its own digests only. So the
    work is digests times the root of the cells, not digests times cells. ``old``: SQL of cell c.
    """
    touches = lambda v, at: " OR ".join(f"{v}.c{j} {at}" for j in range(3))
    into = f"cast(named_struct('n', a.n {sign} x.n, 'k', a.k ^ x.k, 'h', a.h ^ x.h) as {_CELL})"
    group = f"transform(sequence(q * g, least(q * g + g, {cells}) - 1), c -> aggregate(filter(eq, x -> {touches('x', '= c')}), {old}, (a, x) -> {into}))"
    each = f"transform(array(filter(e, x -> {touches('x', 'BETWEEN q * g AND q * g + g - 1')})), eq -> {group})[0]"
    return f"transform(array({digests}), e -> transform(array(cast(ceil(sqrt({cells})) as int)), g -> flatten(transform(sequence(0, cast(({cells} - 1) div g as int)), q -> {each})))[0])[0]"


def sketch(keys: str, cells: str | int) -> str:
    """SQL of the sketch with ``cells`` cells of an array of digests."""
    return _grouped(_hashed(keys, str(cells)), str(cells), f"cast(named_struct('n', 0, 'k', 0L, 'h', 0L) as {_CELL})", "+")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> cast(named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h) as {_CELL}))"


def peel(cells: str, size: str, rounds: int) -> str:
    """SQL of the number of digests that peeling recovers, null where cells remain. It ends when no cell is pure."""
    pure = lambda n: _hashed(f"array_distinct(transform(filter(s.cells, c -> c.n = {n} AND {_CHECK.format(k='c.k')} = c.h), c -> c.k))", size, n)
    state = f"STRUCT<cells: ARRAY<{_CELL}>, found: INT, live: BOOLEAN>"
    after = f"named_struct('cells', {_grouped('ps', size, 's.cells[c]', '-')}, 'found', s.found + size(ps), 'live', true)"
    step = f"(s, r) -> if(NOT s.live, s, transform(array(concat({pure(1)}, {pure(-1)})), ps -> cast(if(size(ps) = 0, named_struct('cells', s.cells, 'found', s.found, 'live', false), {after}) as {state}))[0])"
    return (
        f"aggregate(sequence(1, {rounds}), cast(named_struct('cells', {cells}, 'found', 0, 'live', true) as {state}), {step}, "
        "s -> if(forall(s.cells, c -> c.n = 0 AND c.k = 0 AND c.h = 0), s.found, cast(null as int)))"
    )


def likeness(df: DataFrame, name: str, a: str, b: str, sketch_a: str, sketch_b: str) -> DataFrame:
    """``df`` with ``name``: the Jaccard likeness of the digest arrays a and b by sketch subtraction and peeling."""
    both = f"(size({a}) + size({b}))"
    df = df.withColumn("_diff", F.expr(f"CASE WHEN {sketch_a} = {sketch_b} AND size({a}) = size({b}) THEN 0 WHEN abs(size({a}) - size({b})) <= {CELLS} THEN {peel(subtract(sketch_a, sketch_b), str(CELLS), 40)} END"))
    for cells in (f"3 * ({both} div 2 + 8)", f"3 * ({both} * 2 + 16)"):
        larger = f"transform(array(cast({cells} as int)), m -> {peel(subtract(sketch(a, 'm'), sketch(b, 'm')), 'm', 200)})[0]"
        df = df.withColumn("_diff", F.expr(f"CASE WHEN _diff IS NULL THEN {larger} ELSE _diff END"))
    # a pair that no size could peel: two digests that share all their cells
    exact = f"(size(array_except({a}, {b})) + size(array_except({b}, {a})))"
    df = df.withColumn("_diff", F.expr(f"coalesce(_diff, {exact})"))
    return df.withColumn(name, F.expr(f"if({both} = 0, 1.0D, cast({both} - _diff as double) / ({both} + _diff))")).drop("_diff")


def shown(text: str, keys: str, cells: str) -> Column:
    """The fingerprint as text: paragraph count, a digest of the whole text, then count:XOR:check of each cell."""
    cell = "concat_ws(':', cast(c.n as string), hex(c.k), hex(c.h))"
    return F.expr(f"concat_ws('|', cast(size({keys}) as string), hex(xxhash64(coalesce({text}, ''))), array_join(transform({cells}, c -> if(c.n = 0, '', {cell})), ','))")


def _place(value: str, bounds: str) -> str:
    """SQL: how many of the sorted ``bounds`` are at most ``value``, by halving."""
    steps = ", ".join(str(1 << k) for k in range(20, -1, -1))
    return f"transform(array({bounds}), b -> aggregate(array({steps}), 0, (lo, s) -> if(lo + s <= size(b) AND get(b, lo + s - 1) <= {value}, lo + s, lo)))[0]"


def _quantiles(column: str, parts: int) -> Column:
    """The inner bounds that cut a column into ``parts`` of like many rows, however its values are spread."""
    return F.percentile_approx(column, F.array(*[F.lit(k / parts) for k in range(1, parts)]), max(10_000, 8 * parts))


def with_next(docs: DataFrame, id_col: str, values: list[str]) -> DataFrame:
    """``docs`` with ``next``, a struct of ``values`` of the next document by descending id (the last's is the first)."""
    docs = docs.withColumn("_id", F.col(id_col).cast("long"))
    low, count = docs.agg(F.min("_id"), F.count("*")).first()
    if not count:
        return docs.drop("_id").withColumn("next", F.struct(*values))
    docs = docs.withColumn("_id", F.coalesce("_id", F.lit(0 if low is None else low - 1)))
    ranges = -(-count // RANGE_ROWS)
    parts = min(LEVEL, ranges)
    bounds = docs.agg(_quantiles("_id", parts)).first()[0] if parts > 1 else []  # at most LEVEL numbers
    docs = docs.withColumn("_range", F.expr(_place("_id", f"cast(array({', '.join(f'{x}L' for x in bounds)}) as array<bigint>)")).cast("long"))
    while parts < ranges:  # quantiles inside each quantile
        inner = min(LEVEL, -(-ranges // parts))
        finer = docs.groupBy(F.col("_range").alias("_r")).agg(_quantiles("_id", inner).alias("_b"))
        finer = F.broadcast(finer) if ranges <= BROADCAST_RANGES else finer
        docs = docs.join(finer, F.col("_range") == F.col("_r")).withColumn("_range", F.col("_range") * inner + F.expr(_place("_id", "_b"))).drop("_r", "_b")
        parts *= inner
    # one row per range of about RANGE_ROWS rows: its first id, and the range before it (the lowest, for the highest)
    heads = docs.groupBy("_range").agg(F.max("_id").alias("_head"))
    everything = Window.orderBy(F.col("_range").desc())
    heads = heads.withColumn("_guest", F.coalesce(F.lag("_range").over(everything), F.min("_range").over(Window.partitionBy())))
    heads = heads.select(F.col("_range").alias("_r"), "_head", "_guest")
    # broadcast while it is known to be small; otherwise the join shuffles the texts once more
    heads = F.broadcast(heads) if ranges <= BROADCAST_RANGES else heads
    rows = docs.join(heads, (docs["_range"] == heads["_r"]) & (docs["_id"] == heads["_head"]), "left")
    # a first document is there twice: in its own range, and as a guest behind the rows of the range before
    rows = rows.withColumn("_at", F.explode(F.expr("if(_guest is null, array(named_struct('r', _range, 'g', 0)), array(named_struct('r', _range, 'g', 0), named_struct('r', _guest, 'g', 1)))")))
    order = Window.partitionBy("_at.r").orderBy("_at.g", F.col("_id").desc(), *[F.col(v) for v in values[:1]])
    rows = rows.withColumn("next", F.lead(F.struct(*values)).over(order)).where("_at.g = 0")
    return rows.select(*[c for c in docs.columns if c[0] != "_"], "next")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns: each document, its edited version and its neighbour."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("keys", digests("text"))
    rows = with_next(docs, "doc_id", ["text", "keys"]).withColumn("n_chars", F.length("text").cast("long"))
    third = "cast(n_chars div 3 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {third}), substring(next.text, 1, {third}))"))
    rows = rows.withColumn("edited_keys", digests("edited"))
    rows = rows.withColumns({"next_keys": F.col("next.keys"), "edited_sha256": F.sha2("edited", 256)})
    rows = rows.withColumns({s: F.expr(sketch(k, CELLS)) for s, k in (("own_s", "keys"), ("edited_s", "edited_keys"), ("next_s", "next_keys"))})
    rows = rows.withColumns({"fingerprint": shown("text", "keys", "own_s"), "edited_fingerprint": shown("edited", "edited_keys", "edited_s")})
    rows = likeness(rows.drop("text", "edited", "next"), "near_edited", "keys", "edited_keys", "own_s", "edited_s")
    rows = likeness(rows, "near_next", "keys", "next_keys", "own_s", "next_s")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
