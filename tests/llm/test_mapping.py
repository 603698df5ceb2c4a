"""Problem 4."""

import random

import pytest

from ontospan.llm import mapping

D, R = "CHẨN_ĐOÁN", "THUỐC"
KB = "record_id long, code string, concept_type string, record_name string, name_vi string, name_en string, aliases array<string>, typed string"
ENTRIES = [
    (1, "A1", D, "viêm túi mật cấp tính", None, "acute inflammation of gallbladder", ["viêm túi mật CT"], "x"),
    (2, "A2", D, "viêm túi mật mạn tính", None, None, None, "x"),
    (3, "A3", D, "hẹp van hai lá", None, None, [], "x"),
    (4, "A4", D, "hẹp van hai lá độ II", None, None, [], "x"),
    (5, "B1", R, "galxikitran 50 mg oral tablet", "galxikitran 50 mg viên nén", None, ["Fruvaquel 50 mg"], "x"),
    (6, "B2", R, "galxikitran 500 mg oral tablet", None, None, None, "x"),
    (7, None, R, "nothing 5 mg", None, None, None, "x"),
    (8, "B3", R, "kevvotraxin 20 µg", None, None, None, "x"),
]
CASES = [
    (D, "VIÊM TÚI MẬT CẤP TÍNH", "A1"), (D, "viem tui mat cap tinh", "A1"), (D, "viêm túi mậtcấp tính", "A1"), (D, "viêm túi mtậ cấp tính", "A1"), (D, "viêm túi mật CT", "A1"),
    (D, "cấp tính - viêm túi mật", "A1"), (D, "vieem tuis maatj caaps tinhs", "A1"), (D, "TD viêm túi mật mạn tính ?", "A2"), (D, "acute inflamation of gallbladder", "A1"),
    (D, "viêm túi mật", None), (D, "viêm bàng quang cấp tính", None), (D, "hẹp van hai lá", "A3"), (D, "hẹp van hai lá độ II", "A4"), (D, "hẹp van hai lá độ III", None),
    (D, "hẹp.van.hai.lá", "A3"), (D, "bệnh hẹp van hai lá (đã ổn)", "A3"), (D, "???", None), (D, "", None), (D, None, None), (None, "hẹp van hai lá", None),
    (R, "Galxikitran 50mg", "B1"), (R, "GALXIKITRAN (0,05 g)", "B1"), (R, "galxiktran 500 miligam x 2 viên", "B2"), (R, "50 mg fruvaquel", "B1"), (R, "galxikitran 60 mg", None),
    (R, "galxikitran", None), (R, "kevvotraxin 20mcg", "B3"), (R, "kevvotraxin 20 mg", None), (R, "nothing 5 mg", None), (R, "hẹp van hai lá", None), (D, "x" * 50_000, None),
]


def test_cases(spark):
    kb = spark.createDataFrame(ENTRIES, KB)
    values = spark.createDataFrame([(t, v, "clash", "clash") for t, v, _ in CASES], "concept_type string, text string, code string, words string")
    got = {(r.concept_type, r.text): r.code for r in mapping.mapped(values, kb).collect()}
    wrong = [(t, v[:40] if v else v, c, got.get((t, v))) for t, v, c in CASES if got.get((t, v)) != c]
    assert wrong == []


def test_no_values_and_no_entries(spark):
    kb, values = spark.createDataFrame(ENTRIES, KB), spark.createDataFrame([(D, "a")], "concept_type string, text string")
    assert mapping.mapped(values.where("false"), kb).count() == mapping.mapped(values, kb.where("false")).count() == 0


def test_pigeonhole_loses_no_pair(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    refs = sorted({word(rng.randint(1, 24)) for _ in range(120)})
    typed = set()
    for r in refs:
        s = list(r)
        for _ in range(rng.randint(0, 5)):
            i = rng.randint(0, len(s))
            s[i : i + rng.choice([0, 1])] = rng.choice([[], ["a"], ["b"]])
        typed.add("".join(s))
    distance = lambda a, b: _levenshtein(a, b)
    limit = lambda n: 0 if n < 2 else 1 if n < 6 else 2 if n < 8 else 3 if n < 10 else 4
    expected = {(t, r) for t in typed if t for r in refs if distance(t, r) <= limit(len(r))}
    df = lambda xs: spark.createDataFrame([("k", x) for x in xs], "kind string, key string")
    assert {(x.typed, x.reference) for x in mapping.pigeonhole(df(typed), df(refs)).collect()} == expected


def test_limits_are_a_parameter(spark):
    """As many edits as the caller says, at any length, none lost."""
    base = "abcdefghij" * 6
    typed = [base, base[:7] + "x" + base[8:40] + base[43:], "xx" + base[:-3], "ab", "b", "abc", "cb"]
    limits = ((3, 1), (20, 6))
    df = lambda xs: spark.createDataFrame([("k", x) for x in xs], "kind string, key string")
    got = {(x.typed, x.reference) for x in mapping.pigeonhole(df(typed), df([base, "ab", "abc"]), limits).collect()}
    allowed = lambda n: 6 if n >= 20 else 1 if n >= 3 else 0
    assert got == {(t, r) for t in typed for r in (base, "ab", "abc") if _levenshtein(t, r) <= allowed(len(r))} and len(got) == 6


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("text, keys", [("hẹp màng nhĩ", "hepjmangfnhix"), ("Đường", "dduwowngf"), ("tổn thương", "toonrthuwowng")])
def test_telex(spark, text, keys):
    import unicodedata

    from pyspark.sql import functions as F

    for form in ("NFC", "NFD"):
        assert spark.createDataFrame([(unicodedata.normalize(form, text),)], "x string").select(mapping.telex(F.col("x")).alias("y")).first().y == keys
