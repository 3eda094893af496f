"""Text functions on small literals."""

from pyspark.sql import functions as F

from sessionloom.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_chunk_bounds_overlap(spark):
    row = spark.range(1).select(T.chunk_bounds(F.lit(2500)).alias("a"), T.chunk_bounds(F.lit(1200)).alias("b"), T.chunk_bounds(F.lit(0)).alias("c")).first()
    assert [tuple(x) for x in row["a"]] == [(0, 917), (792, 1709), (1584, 2500)]
    assert [tuple(x) for x in row["b"]] == [(0, 1200)]
    assert row["c"] == []


def test_paths_are_redacted_and_safe_addresses_stay(spark):
    red = lambda s: one(spark, T.redact_paths(F.col("t")), t=s)
    assert red("posix=/Users/Drew Smith/.codex/transcripts/session.jsonl") == "posix=[local-path-redacted]"
    assert red("win=C:\\Users\\x\\a.txt, next") == "win=[local-path-redacted], next"
    assert red("unc=\\\\host\\share\\dir\\a.txt") == "unc=[local-path-redacted]"
    assert red("see file:///srv/data/a.txt") == "see [local-path-redacted]"
    mark = "[local-path-redacted]"
    for bare in ("/Users/Drew Smith/My Folder", "C:\\Users\\Drew Smith\\My Folder", "\\\\host\\a share\\My Folder", "file:///Users/Drew Smith/My Folder"):
        assert red(f'"{bare}"') == f'"{mark}"' and red(bare) == mark and red(f"x=({bare})") == f"x=({mark})"
        assert red(f"open {bare} now") == f"open {mark} Folder now"
    assert red("see /home/a/x.txt and/or y") == f"see {mark} and/or y"
    assert red("in /a/My v1.2 files/x.txt, too") == f"in {mark}, too"
    assert red("either/or 1/2 //x a/b /alone https://e.org/a b/c") == "either/or 1/2 //x a/b /alone https://e.org/a b/c"
    assert red("at /home/a/b:12 and /etc") == f"at {mark}:12 and {mark}"
    assert red("/a" * 50_000) == mark and red("C:" + "\\a b" * 50_000) == mark
    assert red("at https://example.com/home/a.txt and /home/a/b") == "at https://example.com/home/a.txt and [local-path-redacted]"
    assert red("plain words / nothing") == "plain words / nothing"


def test_locators(spark):
    loc = lambda s: one(spark, T.safe_locator(F.col("t")), t=s)
    assert loc("https://example.com/a") == "https://example.com/a"
    assert loc("file:///srv/a.txt") is None
    assert loc("https://example.com/a /home/x/y") is None


def test_filter_reasons(spark):
    reason = lambda s: one(spark, T.filter_reason(F.col("t")), t=s)
    assert reason("\n".join(f"2024-01-01T00:00:00 line {i}" for i in range(850))) == "huge_raw_log"
    assert reason("QUJD" * 100) == "binary_or_base64"
    assert reason("\n".join(["+added"] * 260)) == "unbounded_diff"
    assert reason("\n".join(["the same line of text"] * 700)) == "repeated_generated_file"
    assert reason("just a few words") is None


def test_secret_lines_and_structured_masks(spark):
    kept = one(spark, T.drop_secret_lines(F.col("t")), t="a\npassword = hunter22222\nsk-" + "a" * 24 + "\nb")
    assert kept == "a\nb"
    assert one(spark, T.drop_secret_lines(F.col("t")), t="password: [REDACTED]") == "password: [REDACTED]"
    assert one(spark, T.mask_structured(F.col("t")), t='{"password": "a\\"b", "x": 1}') == '{"password":"[REDACTED]", "x": 1}'


def test_snippet_and_cleaning(spark):
    assert one(spark, T.snippet(F.col("t")), t="a " * 200) == ("a " * 200).strip()[:239] + "..."
    assert one(spark, T.normalize(T.clean(F.col("t"))), t="\x1b[31mred\x1b[0m\nExit code: 0\n\n\n\nx   y") == "red\n\nx y"


def test_pattern_redaction_counts_and_keeps_literals(spark):
    text, hits = T.redact_patterns(F.col("t"), [("a.b", "$x\\", True), ("[0-9]+", "#", False)])
    row = spark.createDataFrame([("a.b axb 12 3",)], "t string").select(text.alias("t"), hits.alias("n")).first()
    assert (row["t"], row["n"]) == ("$x\\ axb # #", 3)


def test_trigrams(spark):
    assert sorted(one(spark, F.array_join(T.trigrams(F.col("t")), "|"), t="ab").split("|")) == ["  a", " ab", "ab "]
