"""Text, medication and consistent-form functions against plain restatements."""

import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontospan.functions import rx, visual
from ontospan.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, key",
    [("Đau  bụng – NẶNG!", "dau bung - nang"), ("Straße", "strasse"), ("ạ́b", "ab"), ("- ho", "- ho"), ("da day: 5,0%", "da day: 5 0%"), ("", ""), (None, None), ("😀 ho", "ho")],
)
def test_keys(spark, raw, key):
    assert one(spark, raw, T.normalize_key) == key


def test_offsets_count_characters(spark):
    df = spark.createDataFrame([("a😀b\nho. sốt cao; đau", 17, 20)], "text string, s int, e int")
    r = df.select(T.clause_before(F.col("text"), F.col("s")).alias("c"), T.line_length(F.col("text"), F.col("s"), F.col("e")).alias("n")).first()
    assert r.c == " " and r.n == 16


def test_trim_span(spark):
    df = spark.createDataFrame([("  đau bụng.; ", 10)], "t string, s int")
    assert tuple(df.select(T.trim_span(F.col("t"), F.col("s")).alias("x")).first().x) == (12, 20, "đau bụng")


def test_token_edits_and_scores(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    rows = df.select(T.token_edits(F.col("a"), F.col("b")).alias("e"), T.token_score(F.col("a"), F.col("b")).alias("s"), T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r.e for r in rows] == [2, 0, 1] and [round(r.s, 4) for r in rows] == [0.3333, 1.0, 0.0] and [round(r.j, 2) for r in rows] == [0.4, 1.0, 0.0]


def test_similarity_is_the_matching_block_ratio(spark):
    pairs = [("viem gan", "viem gan b"), ("", "a"), ("a", "a"), (None, "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.key_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in rows] == [SequenceMatcher(None, *pairs[0]).ratio(), 0.0, 1.0, None]


def test_confidence(spark):
    values = ["0.4", "7", "-1", "nan", "x", None]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(T.confidence(F.col("x")).alias("c")).collect()
    assert [r.c for r in rows] == [0.4, 1.0, 0.0, 0.75, 0.75, 0.75]


@pytest.mark.parametrize(
    "raw, form",
    [("Aspirin 325mg p.o. q 6 h prn", "aspirin 325 mg po. q6h:prn"), ("ASA 81 mg qd", "aspirin 81 mg qd"), ("Omeprazol 20mg BID PRN", "omeprazole 20 mg bid:prn"), (None, None)],
)
def test_prescriptions(spark, raw, form):
    assert one(spark, raw, rx.normalize_rx) == form


def test_strengths_and_relations(spark):
    df = spark.createDataFrame([("a 0.5 g", "a 500 mg tablet"), ("a", "a 5 mg"), ("a 5 mg", "a 10 mg"), ("a 5 mg", "a tablet")], "q string, c string")
    n = lambda c: rx.strengths(rx.normalize_rx(F.col(c)))
    assert [r.r for r in df.select(rx.strength_relation(n("q"), n("c")).alias("r")).collect()] == ["match", "not_requested", "conflict", "missing"]


def test_prefixes(spark):
    n = "metoprolol succinate xl 50 mg po bid"
    assert one(spark, n, rx.without_route) == "metoprolol succinate xl 50 mg"
    assert one(spark, n, rx.without_modifiers) == "metoprolol succinate"
    assert one(spark, "5 mg po aspirin", rx.without_leading_dose) == "aspirin"
    assert one(spark, "a 5 mg x 3 days then", rx.without_count) == "a 5 mg"


def test_extended_end(spark):
    text = "uống aspirin 81 mg po qd, sau ăn"
    df = spark.createDataFrame([(text, 12)], "t string, e int")
    assert text[: df.select(rx.extended_end(F.col("t"), F.col("e")).alias("e")).first().e].endswith("po qd")


def test_consistent_form():
    assert visual.consistent("ａ​б") == "aб"
    assert visual.consistent("hội　 x ") == "hội x"
    assert visual.consistent("m² Ⅱ μg ｇan Ð") == "m² II µg gan Đ"
    assert visual.consistent("SỐT") == "SỐT" and visual.consistent("SỐT", fold_case=True) == "sốt"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_consistent_form_is_stable(text):
    once = visual.consistent(text)
    assert visual.consistent(once) == once
    assert visual.consistent(unicodedata.normalize("NFD", once)) == once


def test_clean_text_is_in_form(spark):
    clean = "viêm gan B (+) 5 mg/dL, µg α β γ đĐ ² x"
    assert visual.consistent(clean) == clean
    assert not spark.createDataFrame([(clean,)], "x string").select(F.col("x").rlike(visual.DIRTY).alias("d")).first().d


def test_column_and_plain_form_agree(spark):
    values = ["a", "", " ", None, "ｈo", "đau bụng", "x" * 100_000 + "​", "а", "đau  bụng"]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(visual.consistent_form(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [None if v is None else visual.consistent(v) for v in values]


def test_characters_that_skip_python_are_in_form(spark):
    """Every character of the class that keeps a value in the JVM is its own form, and folds by lower case alone or goes to Python."""
    import re
    import unicodedata

    from ontospan.functions import visual

    clean = [chr(c) for c in range(0x20, 0x3000) if re.match(f"[{visual.CLEAN}]", chr(c))]
    assert len(clean) > 500 and all(visual.consistent(f"a{c}a") == f"a{c}a" for c in clean)
    apart = [c for c in clean if c != " " and visual.consistent(c, True) != unicodedata.normalize("NFC", c.lower())]
    assert sorted(apart) == sorted(visual.FOLDED_APART)
    rows = spark.createDataFrame([(c,) for c in [*clean, "Straße", "ĳ", "ｆｏO", "ΜΜ", "İ", None, ""]], "x string")
    got = rows.select("x", visual.consistent_form(F.col("x")).alias("form"), visual.consistent_form(F.col("x"), True).alias("folded")).collect()
    assert all((r.form, r.folded) == (None if r.x is None else visual.consistent(r.x), None if r.x is None else visual.consistent(r.x, True)) for r in got)
    assert {r.x: r.folded for r in got}["Straße"] == "strasse"


def test_edits_of_more_tokens_than_letters(spark, monkeypatch):
    monkeypatch.setattr(T, "LETTERS", 3)
    rows = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "x", "c"]), (["a"], ["b"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.n for r in rows.select(T.token_edits(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 1, 1, None]
