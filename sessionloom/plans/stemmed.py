"""Recall by stems: web-style queries whose words and phrases are analyzed as English, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis
from ..operators import recall, websearch
from . import retrieval

ENGLISH = analysis.analyzer("english")


def _queries(segments: DataFrame) -> DataFrame:
    """A query for each turn of every fiftieth conversation: two inflected words but not a third, or a phrase around any word."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(analysis.WORD), F.lit(0))
    some = segments.where("session_id % 50 = 0").select(F.col("segment_id").alias("query_id"), words.alias("a")).where("size(a) >= 8")
    return some.select("query_id", F.expr("concat(a[2], 'ing ', a[3], 's -', a[0], ' OR \"', a[5], ' of ', a[7], '\"')").alias("query"))


def stemmed_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 turns of each query by covers over stems, with the headline that marks all forms of its words."""
    segments = retrieval._turn_segments(spark, sf)
    queries = _queries(segments)
    found = websearch.first_matches(segments.select("segment_id", "text"), queries, 20, analyze=ENGLISH)
    hits = recall.top(found, 20, [F.col("lexical").desc(), "segment_id"])
    texts = segments.select("segment_id", "text")
    shown = websearch.describe(hits, (websearch.forms_of(texts, websearch.terms_of(queries, ENGLISH), ENGLISH), "query_id"), (texts, "segment_id"))
    headline = websearch.headline(F.col("text"), F.col("forms"), analyze=ENGLISH.split)
    return shown.select("query_id", "segment_id", "lexical", F.col("rank").cast("long").alias("rank"), headline.alias("headline"))


def _stems(words: str) -> str:
    """SQL of the stems of the distinct words of ``words`` (word): one step of the published algorithm a table, ``stems`` (m) a map."""
    some, one, many, short, vowel = (f"regexp_matches(x, '{p}')" for p in (analysis.SOME, analysis.ONE, analysis.MANY, analysis.SHORT, analysis.VOWEL))
    table = lambda values: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}[s]"
    mended = f"CASE WHEN regexp_matches(x, '{analysis.DOUBLE}') THEN left(x, length(x) - 1) WHEN regexp_matches(x, '(?:at|bl|iz)$') OR ({one} AND {short}) THEN x || 'e' ELSE x END"
    steps = [
        (("sses", "ies", "ss", "s"), f"x || {table({'sses': 'ss', 'ies': 'i', 'ss': 'ss', 's': ''})}"),
        (("eed", "ed", "ing"), f"CASE WHEN s = 'eed' THEN CASE WHEN {some} THEN x || 'ee' END WHEN {vowel} THEN {mended} END"),
        (("y", "Y"), f"CASE WHEN {vowel} THEN x || 'i' END"),
        (analysis.SECOND, f"CASE WHEN {some} THEN x || {table(analysis.SECOND)} END"),
        (analysis.THIRD, f"CASE WHEN {some} THEN x || {table(analysis.THIRD)} END"),
        (analysis.FOURTH, f"CASE WHEN {many} AND (s <> 'ion' OR regexp_matches(x, '[st]$')) THEN x END"),
        (("e",), f"CASE WHEN {many} OR ({one} AND NOT {short}) THEN x END"),
        (("l",), f"CASE WHEN x LIKE '%l' AND regexp_matches(x || s, '{analysis.MANY}') THEN x END"),
    ]
    out = [f"w0 AS (SELECT word, regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT word FROM {words}))"]
    for i, (suffixes, then) in enumerate(steps):
        cut = f"(SELECT word, w, s, left(w, length(w) - length(s)) AS x FROM (SELECT word, w, regexp_extract(w, '{analysis.ending(suffixes)}', 1) AS s FROM w{i}))"
        out.append(f"w{i + 1} AS (SELECT word, CASE WHEN s = '' THEN w ELSE coalesce({then}, w) END AS w FROM {cut})")
    whole = f"CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN lower(w) ELSE word END"
    stop = ", ".join(f"'{w}'" for w in analysis.STOP_LISTS["english"])
    return ", ".join(out) + f", stems AS (SELECT map_from_entries(list((word, {whole}))) AS m FROM w{len(steps)} WHERE word NOT IN ({stop}))"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def _terms(text: str) -> str:
    """SQL of the terms of a text, null for stop words, by the map of stems."""
    return f"list_transform({_words(text)}, lambda t: m[t])"


def _sql() -> str:
    """Each stretch between the starts and ends of a query's items in a text is looked at; no postings, no walk."""
    ask = "wa[3] || 'ing ' || wa[4] || 's -' || wa[1] || ' OR \"' || wa[6] || ' of ' || wa[8] || '\"'"
    inner = "list_filter(range(1, len(p) + 1), lambda j: p[j] IS NOT NULL)"
    return f"""WITH raw AS (SELECT conv_id * 100 + turn AS segment_id, conv_id AS session_id, text, {_words('text')} AS wa FROM conversations),
  asked AS (SELECT segment_id AS query_id, {ask} AS query FROM raw WHERE session_id % 50 = 0 AND len(wa) >= 8),
  vocabulary AS (SELECT unnest(wa) AS word FROM raw UNION ALL SELECT unnest({_words('query')}) FROM asked),
  {_stems('vocabulary')},
  seg AS (SELECT segment_id, text, {_terms('text')} AS a FROM raw, stems),
  tok AS (SELECT query_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT query_id, regexp_extract_all(query, '-?"[^"]*"|[^\\s"]+') AS x FROM asked)),
  parted AS (SELECT *, sum((lower(w) = 'or')::INT) OVER (PARTITION BY query_id ORDER BY i) AS clause FROM tok),
  loose AS (SELECT query_id, clause, i, w LIKE '-%' AS neg, {_terms('w')} AS p FROM parted, stems WHERE lower(w) <> 'or'),
  item AS (SELECT query_id, clause, i, neg, p[list_min({inner}) : list_max({inner})] AS terms FROM loose WHERE len({inner}) > 0),
  need AS (SELECT query_id, clause, count(*) FILTER (NOT neg) AS k FROM item GROUP BY 1, 2),
  post AS (SELECT segment_id, a, unnest(a) AS t, generate_subscripts(a, 1) AS pos FROM seg),
  spot AS (SELECT query_id, clause, i, neg, segment_id, pos AS s, pos + len(terms) - 1 AS e FROM item JOIN post ON t = terms[1]
    WHERE len(list_filter(range(1, len(terms) + 1), lambda j: terms[j] IS NOT NULL AND a[pos + j - 1] IS DISTINCT FROM terms[j])) = 0),
  stretch AS (SELECT DISTINCT l.query_id, l.clause, l.segment_id, l.s, r.e FROM spot l JOIN spot r ON l.query_id = r.query_id AND l.clause = r.clause AND l.segment_id = r.segment_id AND l.s <= r.e AND NOT l.neg AND NOT r.neg),
  full_ AS (SELECT t.query_id, t.clause, t.segment_id, t.s, t.e FROM stretch t JOIN spot x ON x.query_id = t.query_id AND x.clause = t.clause AND x.segment_id = t.segment_id AND NOT x.neg AND x.s >= t.s AND x.e <= t.e
    JOIN need n ON n.query_id = t.query_id AND n.clause = t.clause GROUP BY ALL HAVING count(DISTINCT x.i) = any_value(n.k)),
  cov AS (SELECT * FROM full_ f WHERE NOT EXISTS (FROM full_ g WHERE g.query_id = f.query_id AND g.clause = f.clause AND g.segment_id = f.segment_id AND g.s >= f.s AND g.e <= f.e AND (g.s > f.s OR g.e < f.e))),
  ranked AS (SELECT query_id, clause, segment_id, sum(4.0::DOUBLE / greatest(4, e - s + 1)) AS lexical FROM cov GROUP BY ALL),
  best AS (SELECT query_id, segment_id, round(max(lexical), 6) AS lexical FROM ranked r WHERE NOT EXISTS (FROM spot x WHERE x.neg AND x.query_id = r.query_id AND x.clause = r.clause AND x.segment_id = r.segment_id) GROUP BY ALL),
  hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, segment_id) AS rank FROM best QUALIFY rank <= 20),
  shown AS (SELECT query_id, flatten(list(terms)) AS shown FROM item WHERE NOT neg GROUP BY 1),
  marked AS (SELECT hit.*, shown, m, regexp_extract_all(text, '\\S+') AS words FROM hit JOIN seg USING (segment_id) JOIN shown USING (query_id), stems),
  hits AS (SELECT *, list_filter(range(1, len(words) + 1), lambda i: len(list_intersect(list_filter({_terms('words[i]')}, lambda t: t IS NOT NULL), shown)) > 0) AS spots FROM marked),
  sized AS (SELECT *, least(len(words), greatest(list_max(list_filter(spots, lambda i: i < spots[1] + {websearch.MOST_WORDS})) - spots[1] + 1, {websearch.LEAST_WORDS})) AS n FROM hits),
  placed AS (SELECT *, least(spots[1], len(words) - n + 1) AS first FROM sized)
  SELECT query_id, segment_id, lexical, rank, array_to_string(list_transform(range(first, first + n), lambda i: CASE WHEN list_contains(spots, i) THEN '<b>' || words[i] || '</b>' ELSE words[i] END), ' ') AS headline FROM placed"""


QUERIES = {"stemmed_recall": stemmed_recall}
ORACLES = {"stemmed_recall": _sql()}
