"""Lexical retrieval for tables of web-style queries: parsing, matches with a cover rank, headlines, metadata of hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions import text as T
from . import search

#: A text to its terms, one a place, null where a word does not count.
Analyzer = Callable[[Column], Column]
#: Covers up to this many terms score 1 each; longer ones score this number by their length.
COVER = 4
#: Most and least words of a headline.
MOST_WORDS, LEAST_WORDS = 24, 8


def parse(queries: DataFrame, analyze: Analyzer = T.analyzed) -> DataFrame:
    """(query_id, item, clause, slot, negative, terms, k) of the items of web-style queries (query_id, query).

    Words must all occur, ``"..."`` is a phrase, a leading minus excludes, and ``or`` parts clauses, one of which must
    hold. ``k`` is the number of items of the clause that must occur; ``slot`` numbers them from 0, excluded items have
    none. Words of which the analyzer leaves nothing are ignored; a query without words has no items, nor has null.
    Places that the analyzer leaves null stay inside a phrase and go at its ends.
    """
    cut = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))).alias("i", "w"))
    clause = F.count_if(F.lower("w") == "or").over(Window.partitionBy("query_id").orderBy("i"))
    items = cut.select("query_id", "i", clause.alias("clause"), F.col("w").startswith("-").alias("negative"), (F.lower("w") == "or").alias("parts"), analyze(F.col("w")).alias("all"))
    places = F.transform("all", lambda t, i: F.when(t.isNotNull(), i))
    items = items.withColumns({"first": F.array_min(places), "last": F.array_max(places)}).where(~F.col("parts") & F.col("first").isNotNull())
    items = items.withColumn("terms", F.slice("all", F.col("first") + 1, F.col("last") - F.col("first") + 1))
    before = F.count_if(~F.col("negative")).over(Window.partitionBy("query_id", "clause").orderBy("i"))
    k = F.count_if(~F.col("negative")).over(Window.partitionBy("query_id", "clause"))
    return items.select("query_id", F.col("i").alias("item"), "clause", F.when(~F.col("negative"), before - 1).cast("int").alias("slot"), "negative", "terms", k.cast("int").alias("k"))


def matches(segments: DataFrame, queries: DataFrame, cover: int = COVER, analyze: Analyzer = T.analyzed) -> DataFrame:
    """(query_id, segment_id, lexical) of the segments that a clause of the query matches.

    The rank of a clause is the sum over its covers, the shortest stretches that hold all of its words and phrases: 1
    for a cover of up to ``cover`` terms, ``cover`` by length beyond that. A query's rank is that of its best clause. A
    clause of excluded words alone matches nothing. Phrases are matched over the analyzed terms: stop words inside
    them do not count with ``text.analyzed``, and hold a place for any word with ``analysis.analyzer``. Only postings of the queries' own terms are joined; segment ids are unique.
    """
    items = parse(queries, analyze).where("k > 0")
    wanted = items.select("query_id", "clause", "slot", "k", F.size("terms").alias("n"), F.size(F.array_compact("terms")).alias("need"), "item", F.posexplode("terms").alias("off", "t")).where("t IS NOT NULL")
    posted = segments.select("segment_id", F.posexplode(analyze(F.col("text"))).alias("pos", "t")).where("t IS NOT NULL")
    found = posted.join(wanted, "t").withColumn("start", F.col("pos") - F.col("off"))
    spots = found.groupBy("query_id", "clause", "segment_id", "k", "item", "slot", "n", "need", "start").agg(F.count("*").alias("have")).where("have = need")
    spot = F.struct((F.col("start") + F.col("n") - 1).alias("stop"), "start", "slot")
    both = spots.groupBy("query_id", "clause", "segment_id", "k").agg(
        F.count_distinct("slot").alias("have"), F.count_if(F.col("slot").isNull()).alias("banned"), F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), spot))).alias("at")
    )
    # a new latest start of all slots is a cover; a later one with the same end lies inside it and takes its place
    walk = f"""aggregate(at, named_struct('last', array_repeat(-1, k), 'least', -1, 'stop', -1, 'gain', 0.0D, 'total', 0.0D),
      (a, x) -> transform(array(transform(a.last, (v, i) -> if(i = x.slot, greatest(v, x.start), v))), l ->
        if(array_min(l) > a.least,
          named_struct('last', l, 'least', array_min(l), 'stop', x.stop, 'gain', {cover}.0D / greatest({cover}, x.stop - array_min(l) + 1),
            'total', a.total + {cover}.0D / greatest({cover}, x.stop - array_min(l) + 1) - if(x.stop = a.stop, a.gain, 0.0D)),
          named_struct('last', l, 'least', a.least, 'stop', a.stop, 'gain', a.gain, 'total', a.total)))[0], a -> a.total)"""
    ranked = both.where("have = k AND banned = 0").withColumn("lexical", F.expr(walk))
    return ranked.groupBy("query_id", "segment_id").agg(F.max("lexical").alias("lexical"))


def first_matches(segments: DataFrame, queries: DataFrame, limit: int, cover: int = COVER, analyze: Analyzer = T.analyzed, digits: int = 6) -> DataFrame:
    """What :func:`matches` gives, with ranks of so many digits, as far as it may be among a query's first ``limit`` by
    rank and segment id. No postings are joined: blocks of segments are searched."""
    items = parse(queries, analyze).where("k > 0")
    asked = items.groupBy("query_id").agg(F.collect_list(F.struct("clause", "slot", "negative", "terms", "k")).alias("items"))
    return search.first_matches(segments, asked.withColumn("items", F.col("items").cast(search.ITEMS)), analyze, limit, search.summed(cover, digits))


def terms_of(queries: DataFrame, analyze: Analyzer = T.analyzed) -> DataFrame:
    """(query_id, shown): the words that a headline of the query marks."""
    return parse(queries, analyze).where("NOT negative").groupBy("query_id").agg(F.array_distinct(F.array_compact(F.flatten(F.collect_list("terms")))).alias("shown"))


def headline(text: Column, shown: Column, most: int = MOST_WORDS, least: int = LEAST_WORDS, analyze: Analyzer = T.analyzed) -> Column:
    """Words of the text from the first hit to the last one within ``most`` words, ``least`` words at the least where
    the text has them; hits stand in ``<b>``. Null without a hit."""
    hit = lambda w: F.coalesce(F.arrays_overlap(analyze(w), shown), F.lit(False))

    def cut(words: Column, at: Column) -> Column:
        first = F.get(at, F.lit(0))
        last = F.array_max(F.filter(at, lambda i: i < first + most))
        size = F.least(F.size(words), F.greatest(last - first + 1, F.lit(least)))
        start = F.least(first, F.size(words) - size)
        part = F.transform(F.slice(words, start + 1, size), lambda w, i: F.when(F.array_contains(at, start + i), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
        return F.when(first.isNotNull(), F.array_join(part, " "))

    spots = lambda words: F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    return analysis.let(T.tokens(text), lambda words: analysis.let(spots(words), lambda at: cut(words, at)))


def forms_of(texts: DataFrame, terms: DataFrame, analyze: analysis.Words) -> DataFrame:
    """(query_id, forms): all words of the texts whose terms are a query's (query_id, shown). Each distinct word is analyzed once."""
    words = texts.select(F.explode(F.array_distinct(analyze.split(F.col("text")))).alias("word")).distinct()
    # a word is little data and much work: by bytes, all words could be one task. Were the term nullable, the join would
    # ask for it before the words are made distinct
    term = F.coalesce(analyze.term(F.col("word")), F.lit("")).alias("term")
    words = words.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word").select("word", term)
    return terms.select("query_id", F.explode("shown").alias("term")).join(words, "term").groupBy("query_id").agg(F.collect_list("word").alias("forms"))


def describe(hits: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """The columns of each table joined to the hits by its key; hits without a row stay.

    Called after the first hits of each query are chosen: the side that is shuffled or sent about is the hits', and the
    planner broadcasts it only where it is small.
    """
    for table, key in tables:
        hits = hits.join(table, key, "left")
    return hits
