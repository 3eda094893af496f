"""Awkward inputs for every operator and stage: clashing columns, repeated rows, empty tables, very long texts, odd letters."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import common, fingerprints, html, language, mixing, neardups, packing, pii, secrets, substrings

from ..conftest import SMALL
from . import brute
from .test_operators import SCHEMA, by_id, corpus, sentence

CLASHES = ("n", "size", "score", "lang_pred", "_kept", "_u", "_row", "row", "doc", "id", "target", "taken", "spans", "copy", "left", "cut", "digest", "rep", "n_chars_2", "a b")


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.fixture(scope="module")
def odd(spark):
    """The corpus with every row twice and columns whose names clash with those used inside."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs = docs.unionByName(docs).repartition(3)
    return docs.select("*", *[F.lit(f"user's {c}").alias(c) for c in CLASHES])


def test_operators_keep_columns_of_any_name(odd):
    for out in (mixing.mix(odd), neardups.keep_one(odd), language.keep_known(odd), pii.sanitize(odd), secrets.mask_secrets(odd)):
        assert out.columns == odd.columns
        assert out.select(*[F.col(f"`{c}`") for c in CLASHES]).distinct().collect() == [tuple(f"user's {c}" for c in CLASHES)]


@pytest.mark.parametrize("number", range(5))
def test_stages_of_empty_and_repeated_tables(spark, odd, number):
    name, stage = stages()[number]
    none = stage(spark, spark.createDataFrame([], SCHEMA), SMALL)
    assert none.count() == 0 and (number == 4 or none.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    out = stage(spark, odd, SMALL)
    assert number == 4 or out.columns == odd.columns
    assert (out.count() <= odd.count()) or number > 2


def test_repeated_rows_have_a_row_each(odd):
    docs, n = odd, 2 * len(corpus())
    for out in (secrets.secret_report(docs), fingerprints.fingerprint_report(docs), substrings.remove_repeats(docs), neardups.near_duplicate_report(docs), mixing.mixing_report(docs), pii.pii_report(docs), language.language_report(docs)):
        assert out.count() == n
    assert packing.pack(docs).where("start = 0").count() == n


def test_token_ids_of_all_letters():
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(0)
    some = [chr(c) for c in (*range(32, 0x250), *range(0x300, 0x340), *range(0x370, 0x400), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB10), 0xAC00, 0x1100, 0x1161, 9, 10, 0x85, 0x2028)]
    latin, signs = "abcdefghijklmnopqrstuvwxyzABCÉİıßẞſÀğŞ", ".,;!?'  \n-_*0123"
    texts = ["".join(rng.choice(rng.choice([some, latin, latin, signs])) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["SERGİ.", "ALİ!", "İ.", "DENİZİ:", "it's we'll 'S x'T", "<|endoftext|> a<|startoftext|>b <|endo", ""]
    ids, at = tokenizer(pa.array([*texts, None]))
    for i, text in enumerate([*texts, ""]):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, text
    long = " ".join(texts)
    parts = [tokenizer(x)[0] for _, x in packing.slices(pa.array([long]), 3000)]
    assert len(parts) > 20 and np.concatenate(parts).tolist() == tokenizer.tokenizer.encode(long, add_special_tokens=False).ids


def test_another_kind_of_tokenizer_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="word ends"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_very_long_texts(spark):
    rng = random.Random(3)
    text = sentence(rng, 60_000) + " a.b@c.org token=abcdefghijkl1234 " + sentence(rng, 60_000)
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short a.b@c.org", "en", "s", 15)], SCHEMA)
    assert by_id(secrets.secret_report(docs), "base_sha256")[1] == brute.digest(brute.secrets(text))
    assert by_id(pii.pii_report(docs), "base_sha256")[1] == brute.digest(brute.private(text))
    assert by_id(fingerprints.fingerprint_report(docs), "n_chars")[1] == len(text)
    assert by_id(substrings.remove_repeats(docs), "n_bytes")[1] == len(text)
    assert by_id(language.language_report(docs), "lang_pred")[1] in ("en", "und")
    ids = packing.WordTokenizer(packing.default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids
    whole = np.array([*ids, 2], dtype="<u4")
    pieces = packing.pack(docs).where("doc_id = 1").orderBy("start").collect()
    assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces]
    assert sum(r["length"] for r in pieces) == len(whole)


def test_all_counts_of_secrets_and_personal_data(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for report, plain, kinds in ((secrets.secret_report, brute.secrets, ("assign", "access", "hex")), (pii.pii_report, brute.private, ("email", "ip", "card", "phone"))):
        got = {r["doc_id"]: r.asDict() for r in report(docs).collect()}
        for i, text, *_ in corpus():
            want = plain(text)
            assert [got[i][f"n_{k}"] for k in kinds] == [sum(x == k for x, _, _ in want) for k in kinds]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i]["spans"].split(","))


def test_terms_reveal_by_plain_counting(spark):
    """The disclosing terms against the same counts over windows in plain Python."""
    import math
    import re

    rng = random.Random(12)
    names = ["Quillon", "Brascombe", "Tarvick"]
    rows = [(i, sentence(rng, rng.randrange(5, 25)) + (f" {names[i % 3]} wrote user{i % 6}@host.org today" if i % 5 == 0 else " nothing here"), None, None, 0) for i in range(150)]
    numbered = pii.numbered(spark.createDataFrame(rows, SCHEMA), "text")
    found = {(r["term"], r["entity"]): r["revealed"] for r in pii.disclosing_terms(numbered)[0].collect()}
    letters, cut = r"[^\W\d_]", re.compile(rf"[^\n]{{1,{pii.WINDOW}}}[^\W_]*\n?|\n")
    windows, counts, both, entities = 0, {}, {}, {}
    for _, text, *_ in rows:
        at = 0
        for w in cut.findall(text):
            low = w.lower()
            terms = set(re.findall(rf"{letters}{{3,}}", low)) | set(re.findall(rf"(?<!{letters})(?=({letters}{{3,}} {letters}{{3,}}))", low))
            windows += 1
            held = {k for k, a, b in brute.private(text) if a < at + len(w) and b > at} | {f"{k} {text[a:b].lower()}" for k, a, b in brute.private(text) if a < at + len(w) and b > at}
            for t in terms:
                counts[t] = counts.get(t, 0) + 1
            for e in held:
                entities[e] = entities.get(e, 0) + 1
                for t in terms:
                    both.setdefault((t, e), []).append(w)
            at += len(w)
    want = {}
    for (t, e), seen in both.items():
        if len(set(seen)) >= (pii.VALUE_SUPPORT if " " in e else pii.KIND_SUPPORT):
            revealed = math.log2(len(seen) * windows / (counts[t] * entities[e])) / max(math.log2(windows / entities[e]), 1e-9)
            if revealed >= pii.DISCLOSURE:
                want[t, e] = revealed
    assert {t for t, _ in want} & {"quillon", "brascombe", "tarvick"}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_spans_of_terms_touch_no_other_span(spark):
    text = "mail of Zorbanax " * 300 + "a@b.co zorbanax@b.co " * 300
    rows = [(i, text if i == 0 else f"Zorbanax {i}@mail.org and so on", None, None, 0) for i in range(30)]
    spans = by_id(pii.pii_report(spark.createDataFrame(rows, SCHEMA)), "spans")[0].split(",")
    places = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans)
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
    assert all(text[a:b].lower().startswith(("mail", "zorbanax", "a@b.co")) for a, b in places)


def test_running_sums_and_maxima(spark):
    rng = random.Random(4)
    for n in (0, 1, 31, 32, 33, 200):
        x = [rng.randrange(1, 100) for _ in range(n)]
        df = spark.createDataFrame([(x,)], "x array<int>").select(F.expr(pii.running("x")).alias("s"), F.expr(pii.running("x", "greatest(a, x)")).alias("m"))
        assert tuple(df.first()) == ([sum(x[:i]) for i in range(n)], [max([0, *x[:i]]) for i in range(n)])


def test_fingerprints_of_many_paragraphs_and_an_outlier_id(spark):
    rng = random.Random(8)
    lines = [sentence(rng, 3) + str(i) for i in range(4000)]
    docs = spark.createDataFrame([(1, "\n".join(lines), None, None, 0), (2, "\n".join(lines[60:] + ["new line"]), None, None, 0)], SCHEMA)
    assert by_id(fingerprints.fingerprint_report(docs), "near_next")[2] == pytest.approx(3940 / 4001)
    ids = spark.range(9000).select(F.when(F.col("id") == 7, 10**18).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    for level in (1024, 2):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(fingerprints, "LEVEL", level)
            rows = fingerprints.with_next(ids, "doc_id", ["text"])
            got = {r["doc_id"]: int(r["next"][0]) for r in rows.collect()}
        order = sorted(got, reverse=True)
        assert all(got[i] == (order[(k + 1) % len(order)] if order[(k + 1) % len(order)] < 10**18 else 7) for k, i in enumerate(order))


def test_signatures_of_large_counts():
    """A weight of a million takes as little work as one of twenty bits, and similarity is still estimated."""
    one = np.array([1 << 20, 1000], dtype=np.int64)
    doc, shingle = np.array([0, 1, 1]), np.array([5, 5, 9], dtype=np.uint64)
    sign = neardups.signatures(doc, shingle, np.array([one[0], one[0] // 2, 300_000]), 2, 2048)
    true = (one[0] // 2) / (one[0] + 300_000)
    assert abs((sign[0] == sign[1]).mean() - true) < 4 * (true * (1 - true) / 2048) ** 0.5


def test_hot_join_deals_out_a_hot_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = many.groupBy("k").agg(F.count("*").alias("n"))
    got = common.hot_join(many, one, "k", "n", "v")
    assert got.count() == 3000 and got.where("k = 1 AND n = 2000").count() == 2000


def test_tags_are_read_once_and_quotes_need_an_equals_sign():
    texts = lambda page: [b.text for b in html.leaf_blocks(page)]
    assert texts("<p class=it's>One</p><p title=\"a>b\">Two") == ["One", "Two"]
    assert texts("<p>Let x be <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p>") == ["Let x be x=2 here."]
    assert texts("<p>a</p><object><p>b</p></object><noscript>c</noscript>d<!-- e") == ["a", "b", "c", "d"]
    for page in ('<a title="x' * 50_000, '<a title="x' * 50_000 + ">", "<p class='x" * 50_000, "<" * 50_000):
        html.leaf_blocks(page)  # ends within seconds


def test_gradient_of_the_chain_is_that_of_the_likelihood():
    """Training raises the likelihood to where brute force over all label paths agrees with the data."""
    page = "<div class=m><p>Main one, long enough.</p></div><div class=o><p>Other one.</p></div>"
    blocks = html.leaf_blocks(page)
    model = html.train([(blocks, [1, 0], False)] * 3, rounds=60)
    scores = html._sigmas(blocks, model.weights)
    weight = {(a, b): np.exp(scores[0, a] + scores[1, b] + model.step[a, b]) for a in (0, 1) for b in (0, 1)}
    assert weight[1, 0] / sum(weight.values()) > 0.95


def test_expected_counts_against_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "▁a", "▁ab", "aba", "ababababab"]
    probs = np.zeros(len(pieces) + 2)
    probs[: len(pieces)], probs[-2] = [0.1, 0.2, 0.05, 0.07, 0.3, 0.11, 0.02, 0.04], 0.001
    lattice, word = language.Lattice(pieces), "▁abababababbab"
    table = dict(zip(pieces, probs, strict=False))

    def walk(rest, weight, used):
        if not rest:
            yield weight, used
        for k in range(1, len(rest) + 1):
            p = table.get(rest[:k], 0.001 if k == 1 else 0.0)
            if p:
                yield from walk(rest[k:], weight * p, [*used, rest[:k]])

    paths = list(walk(word, 1.0, []))
    total = sum(w for w, _ in paths)
    want = [sum(w * used.count(x) for w, used in paths) / total for x in pieces]
    ids, n = lattice.ids([word])
    for got in (lattice.expected(ids, n, probs, np.ones(1)), lattice._expected_long(ids, n, probs, np.ones(1))):
        assert got[: len(pieces)] == pytest.approx(want)
