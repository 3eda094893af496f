"""Mixing on repeated rows, against its SQL and by its rows, and what of it is shuffled."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import mixing

from ..conftest import same_rows

SCHEMA = "doc_id long, text string, source string, n_chars long"


def texts(rng, n, ids, lengths):
    rows = [(rng.choice(ids), " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice(lengths))), rng.choice(["a", "b", "c", None])) for _ in range(n)]
    return [(i, t, s, len(t)) for i, t, s in rows]


@pytest.mark.parametrize("ids, lengths", [(range(4), (3,)), (range(40), (0, 3, 5)), (range(10**6), (0, 1, 7, 50))])
def test_mix_of_repeated_rows_equals_its_sql(spark, tmp_path, ids, lengths):
    rng = random.Random(len(ids))
    docs = spark.createDataFrame(texts(rng, 600, ids, lengths), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, rng.choice([0, 1, None])) for i in range(30) for _ in range(2)], "doc_id long, quality int")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    same_rows(mixing.mixing_report(docs, labels), con, mixing.ORACLE_SQL)


def test_mix_of_rows_that_share_a_place_reaches_the_targets(spark):
    # without ids every document of a source and size has one place; the order among them is by their texts
    docs = spark.createDataFrame([(None, *r[1:]) for r in texts(random.Random(2), 500, [0], (4,))] + [(-1, "x y z", "a", 5)], SCHEMA)
    target = {r["source"]: r["target"] for r in mixing.choose(docs).select("source", "target").distinct().collect()}
    mixed = sorted((tuple(r) for r in mixing.mix(docs).collect()), key=repr)
    assert mixed == sorted((tuple(r) for r in mixing.mix(docs.repartition(5, "text")).collect()), key=repr)
    taken = dict.fromkeys(target, 0)
    for _, text, source, n_chars in mixed:
        taken[source] += len(text.split())
        assert len(text) == n_chars
    assert taken == {s: round(t) for s, t in target.items()}
    assert sum(len(r[1].split()) < 3 for r in mixed) <= len(target)


def test_texts_are_shuffled_once(spark, tmp_path, capsys):
    docs, labels = f"{tmp_path}/docs", f"{tmp_path}/labels"
    spark.createDataFrame(texts(random.Random(3), 400, range(10**6), (50,)), SCHEMA).write.parquet(docs)
    spark.range(30000).select(F.xxhash64("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).write.parquet(labels)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")  # both tables are larger, as large ones are with the default
    try:
        mixing.mix(spark.read.parquet(docs), spark.read.parquet(labels)).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    assert len(shuffled) > 1
    assert sum("doc#" in x or "text#" in x for x in shuffled) == 1
