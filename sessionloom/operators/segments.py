"""Turns to search segments in one job: filters by part, tool groups, chunks, kinds and provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sessions import tool_pairs, tool_runs

#: Fixed value: how the span of a chunk within its turn was found.
ESTIMATE = "search_text_offset_within_turn_raw_span"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filtered(text: Column) -> Column:
    """(reason, kept) of a part's text: empty and noisy texts keep nothing, secrets are masked and their lines go."""

    def judge(x: Column) -> Column:
        secret = F.when((x["masked"] != x["plain"]) | F.exists(T.lines(x["masked"]), lambda line: T.obvious_secret(line)), "secret")
        kept = F.when((x["plain"] == "") | x["noise"].isNotNull(), "").otherwise(T.normalize(T.drop_secret_lines(x["masked"])))
        return F.struct(F.when(x["plain"] != "", F.coalesce(x["noise"], secret)).alias("reason"), kept.alias("kept"))

    plain = T.clean(F.coalesce(text, F.lit("")))
    return once(plain, lambda p: once(F.struct(p.alias("plain"), T.mask_structured(p).alias("masked"), T.filter_reason(p).alias("noise")), judge))


def token_span(text: Column, first: Column, end: Column) -> tuple[Column, Column]:
    """Places in code points of the tokens [first, end) of a text: where the first starts and the last stops."""
    gap = F.split(text, r"\S+", -1)
    word = T.tokens(text)
    upto = lambda parts, n: F.length(F.array_join(F.slice(parts, F.lit(1), n), ""))
    return upto(gap, first + 1) + upto(word, first), upto(gap, end) + upto(word, end)


def derive(turns: DataFrame) -> DataFrame:
    """Segments of turns (session_id, turn_id, ordinal, actor_kind, role, parts, raw_span), densely numbered a session.

    A turn whose parts all keep nothing gives one skipped segment without text; a turn without parts gives none. A call
    and a result of the same id in one run of tool turns are a group: their segments name both. A chunk's raw span is
    the turn's, moved by the chunk's place in the search text and cut to the turn's span; a turn with no raw span
    gives none. Turn ids and (session, ordinal) are unique. A part without any text is taken as its JSON.
    """
    kind = lambda name: F.exists("parts", lambda p: p["type"] == name)
    calls = F.array_distinct(F.filter(F.transform("parts", lambda p: F.when(p["type"].isin("tool_call", "tool_result"), p["call_id"])), lambda c: c.isNotNull()))
    tools = turns.select("session_id", "ordinal", F.when(kind("tool_call"), "tool_call").when(kind("tool_result"), "tool_result").otherwise("text").alias("part_type"), F.when(F.size(calls) == 1, F.get(calls, F.lit(0))).alias("call_id"))
    pairs = tool_pairs(tool_runs(tools)).where("call_id IS NOT NULL")
    member = F.explode(F.array(*[F.struct(F.col(c).alias("ordinal"), F.lit(i).alias("member_index")) for i, c in enumerate(("call_at", "result_at"))]))
    groups = pairs.select("session_id", F.col("call_id").alias("group_call"), F.array("call_at", "result_at").alias("group_ordinals"), member.alias("m")).select("session_id", "group_call", "group_ordinals", "m.*")

    rows = turns.join(groups, ["session_id", "ordinal"], "left").withColumn("found", F.transform("parts", lambda p: filtered(T.part_text(p))))
    kept = F.filter(F.transform("found", lambda f: f["kept"]), lambda k: k != "")
    rows = rows.withColumn("search_text", T.normalize(F.array_join(kept, "\n"))).where(F.size("parts") > 0)
    rows = rows.withColumn("skipped_parts", F.size("parts") - F.size(kept))
    rows = rows.withColumn("bounds", T.chunk_bounds(F.size(T.tokens(F.col("search_text")))))
    one = rows.select("*", F.size("bounds").alias("chunk_count"), F.posexplode_outer("bounds").alias("chunk_index", "b"))

    start, end = token_span(F.col("search_text"), F.col("b.token_start"), F.col("b.token_end"))
    grouped = F.col("group_call").isNotNull()
    base = F.when(~grouped, "turn").when(kind("tool_call"), "tool_group_call").when(kind("tool_result"), "tool_group_result").otherwise("tool_group_member")
    skipped = F.when(grouped, "tool_group_skipped").otherwise("turn_skipped")
    shown = F.when(F.col("b").isNull(), skipped).when(F.col("chunk_count") == 1, base).otherwise(F.concat(base, F.lit("_chunk")))
    one = one.withColumn("segment_kind", shown).withColumn("char_start", start).withColumn("char_end", end)
    text = F.coalesce(F.substring("search_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")), F.lit(""))
    low, high = F.col("raw_span.char_start"), F.col("raw_span.char_end")
    whole = (F.col("char_start") == 0) & (F.col("char_end") == F.length("search_text"))
    moved = lambda c: F.when(whole, F.when(F.lit(c == "char_end"), high).otherwise(low)).otherwise(F.least(low + F.col(c), high))
    span = F.when(F.col("b").isNotNull() & (high >= low), F.struct(moved("char_start").alias("char_start"), moved("char_end").alias("char_end"), F.when(~whole, ESTIMATE).alias("estimate")))
    reasons = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda f: f["reason"]), lambda r: r.isNotNull())))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal", "chunk_index")) - 1
    return one.select(
        "session_id", number.alias("segment"), "turn_id", "ordinal", "actor_kind", "role", "segment_kind", "chunk_index", F.when(F.col("b").isNotNull(), F.col("chunk_count")).alias("chunk_count"),
        "char_start", "char_end", "b.token_start", "b.token_end", text.alias("search_text"), F.when(F.col("b").isNotNull(), T.snippet(text)).alias("snippet"),
        F.transform("parts", lambda p: F.coalesce(p["type"], F.lit("unknown"))).alias("part_types"), reasons.alias("filter_reasons"), "skipped_parts",
        span.alias("segment_raw_span"), "raw_span", "group_call", "group_ordinals", "member_index",
    )
