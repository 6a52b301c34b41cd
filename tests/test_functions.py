"""Cleaning, tokens and scalar functions on hand-computed rows."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import clean as C
from textloom.functions import scalars as S
from textloom.functions import tokens as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [
    (None, ""), ("", ""), ("Hello, WORLD!", "hello world"), ("see https://a.b/c?d now", "see now"), ("www.x.org <b>Bold</b> it's 42", "bold it's 42"),
    ('<a href="http://x">y', "a href"), ("  many   spaces ", "many spaces"),
])
def test_basic_clean(spark, text, want):
    assert one(spark, text, C.basic_clean) == want


def test_serving_clean_keeps_tag_names(spark):
    assert one(spark, "<b>Bold</b>", C.serving_clean) == "b bold b"


def test_basic_clean_is_idempotent(spark):
    texts = ["A <i>b</i> c's www.x.y", "élan 5%", "don't"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").withColumn("y", C.basic_clean(F.col("x")))
    assert all(r.y == r.z for r in df.withColumn("z", C.basic_clean(F.col("y"))).collect())


@pytest.mark.parametrize("text,want", [
    ("keep\n\nwaterproof coat\nAbout us\n**Edit: x\nUPDATE: y\nlast", "keep\nlast"), (None, ""), ("a\r\nb c", "a\nb c"), ("proof", ""),
])
def test_strip_boilerplate_lines(spark, text, want):
    assert one(spark, text, C.strip_boilerplate_lines) == want


def test_drop_boilerplate_sentences(spark):
    long = "One two three four five six. Proof is here now. Seven eight nine ten eleven twelve thirteen."
    assert one(spark, long, C.drop_boilerplate_sentences) == "One two three four five six. Seven eight nine ten eleven twelve thirteen."
    assert one(spark, "Proof here. Short.", C.drop_boilerplate_sentences) == "Proof here. Short."


def test_full_clean(spark):
    text = "Read [this page](https://x.y/z) *now* 😀 #tag u/some_user @naïve 12 ﬁne\nlearn more here"
    assert one(spark, text, C.full_clean) == "read this page now fine"


def test_mojibake_runs_in_order(spark):
    assert one(spark, "itâ€™s Â£5 â€œqâ€\x9d â€¦", C.repair_mojibake) == "it's £5 \"q\" ..."


@pytest.mark.parametrize("token,want", [("running", "runn"), ("flies", "flie"), ("parties", "party"), ("classes", "class"), ("organization", "organ"), ("thing", "thing"), ("cats", "cat"), ("is", "is"), ("badly", "bad")])
def test_stem(spark, token, want):
    assert one(spark, token, T.stem) == want


def test_stem_rules_against_a_restatement(spark):
    def restated(t, suffixes):
        if len(t) > 3:
            for s in suffixes:
                if t.endswith(s) and len(t) - len(s) >= 3:
                    return t[: len(t) - len(s)] + {"ies": "y", "sses": "ss"}.get(s, "")
        return t

    words = [a + s for a in ("a", "ab", "abc", "abcd") for s in [*T.SUFFIXES_LONG, "", "x"]]
    df = spark.createDataFrame([(w,) for w in words], "x string").select("x", T.stem(F.col("x")).alias("y"), T.stem(F.col("x"), T.SUFFIXES_LONG).alias("z"))
    for r in df.collect():
        assert (r.y, r.z) == (restated(r.x, T.SUFFIXES), restated(r.x, T.SUFFIXES_LONG))
        assert len(r.y) <= len(r.x)


def test_variants(spark):
    text = "The cats aren't running, no 5 items"
    assert one(spark, text, lambda c: T.variant(c, "v1_basic")) == ["the", "cats", "aren't", "running", "no", "items"]
    assert one(spark, text, lambda c: T.variant(c, "v2_no_stop")) == ["cats", "aren't", "running", "items"]
    assert one(spark, text, lambda c: T.variant(c, "v3_stem")) == ["cat", "aren't", "runn", "item"]
    with pytest.raises(ValueError):
        T.variant(F.col("x"), "v9")


def test_preprocess_truncates_and_flags(spark):
    df = spark.createDataFrame([(1, " ".join(f"wordx{chr(97 + i % 26)}q" for i in range(400))), (2, None), (3, "The of and")], "doc_id long, text string")
    rows = {r.doc_id: r for r in T.preprocess(df, "text").collect()}
    assert len(rows[1].stemmed_tokens) == 350 and rows[1].was_truncated_for_analysis
    assert rows[2].stemmed_tokens == [] and rows[2].final_text == "" and not rows[2].was_truncated_for_analysis
    assert rows[3].tokens == ["the", "of", "and"] and rows[3].tokens_no_stop == []


@pytest.mark.parametrize("raw,want", [(None, "neutral"), ("", "neutral"), (" POSitive", "positive"), ("negpos", "positive"), ("Negative.", "negative"), ("meh", "neutral")])
def test_normalize_label(spark, raw, want):
    assert one(spark, raw, S.normalize_label) == want


@pytest.mark.parametrize("x,want", [(0.05, "positive"), (-0.05, "negative"), (0.049, "neutral")])
def test_threshold_label(spark, x, want):
    assert one(spark, x, S.threshold_label, "double") == want


@pytest.mark.parametrize("x,want", [("12", 12), ("12.0", 0), ("x", 0), (None, 0), ("-3", -3)])
def test_lenient_int(spark, x, want):
    assert one(spark, x, S.lenient_int) == want


def test_dates(spark):
    df = spark.createDataFrame([(0.0,), (1700000000.25,)], "x double").select(S.iso_utc(S.epoch_timestamp(F.col("x"))).alias("i"), S.weekday_name(S.epoch_timestamp(F.col("x"))).alias("d"))
    assert [tuple(r) for r in df.collect()] == [("1970-01-01T00:00:00+00:00", "Thursday"), ("2023-11-14T22:13:20.250000+00:00", "Tuesday")]
    assert one(spark, "bad", lambda c: S.iso_utc(S.epoch_timestamp(c))) is None


def test_term_in(spark):
    df = spark.createDataFrame([("An Election.", "election"), ("x", ""), (None, "a")], "t string, q string")
    assert [r.y for r in df.select(S.term_in(F.col("t"), F.col("q")).alias("y")).collect()] == [True, False, False]


def test_cache_key(spark):
    import hashlib

    df = spark.createDataFrame([("p",)], "x string").select(S.cache_key(F.lit("none"), F.lit("m"), F.col("x")).alias("y"))
    assert df.first().y == hashlib.sha256(b"none::m::p").hexdigest()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-20, 20), min_size=2, max_size=5))
def test_softmax_confidence(spark, xs):
    want = max(math.exp(x) for x in xs) / sum(math.exp(x) for x in xs)
    assert abs(one(spark, xs, S.softmax_confidence, "array<double>") - want) < 1e-9


def test_percent_text(spark):
    assert [one(spark, x, S.percent_text, "double") for x in (0.5, None, float("nan"))] == ["50.00%", "n/a", "n/a"]
