"""Problems 8 and 9."""

import os

import pytest

from ontospan.llm import mixing, truncation

DOCS = "doc_id long, source string, lang string, note_kind string, text string, tokens int, repeats int"
TARGETS = "mix_source string, target_share double, max_repeats int"


def test_fit_meets_sources_and_caps():
    cells = [("a", "vi", "n", 900.0), ("a", "en", "n", 100.0), ("b", "vi", "q", 100.0), ("b", "en", "n", 20.0), ("c", "vi", "n", 50.0)]
    w = mixing.fit(cells, {"a": 0.5, "b": 0.3, "c": 0.2, "gone": 0.1}, {"a": 1, "b": 3, "c": 4, "gone": 2})
    got = {s: sum(w[c[:3]] * c[3] for c in cells if c[0] == s) for s in "abc"}
    total = sum(got.values())
    assert all(got[s] / total == pytest.approx(share, rel=1e-6) for s, share in zip("abc", (0.5, 0.3, 0.2)))
    assert all(x <= {"a": 1, "b": 3, "c": 4}[k[0]] + 1e-9 for k, x in w.items()) and total == pytest.approx(1000)
    assert mixing.fit([], {"a": 1.0}, {"a": 1}) == {}
    # without binding caps the fit is the classical one: odds ratios stay, both marginals are met
    table = [("a", "vi", "n", 40.0), ("a", "en", "n", 10.0), ("b", "vi", "n", 20.0), ("b", "en", "n", 30.0)]
    x = mixing.fit(table, {"a": 0.3, "b": 0.7}, {"a": 9, "b": 9}, 50)
    t = {c[:2]: x[c[:3]] * c[3] for c in table}
    assert t["a", "vi"] + t["b", "vi"] == pytest.approx(50 * 0.6, rel=1e-6) and t["a", "vi"] + t["a", "en"] == pytest.approx(15, rel=1e-6)
    assert t["a", "vi"] * t["b", "en"] / (t["a", "en"] * t["b", "vi"]) == pytest.approx(40 * 30 / (10 * 20), rel=1e-6)
    assert sum(x * c[3] for c, x in zip(cells, mixing.fit(cells, {"a": 1.0}, {"a": 2}, 300).values())) == pytest.approx(300)


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer here")
def test_mix(spark):
    rows = [(i, ["Big", "big ", "BIG"][i % 3], "vi", "note", f"chữ {i} " * 30, 0, 0) for i in range(600)]
    rows += [(1000 + i, "sm-all", None, None, f"từ khác {i} " * 30, 0, 0) for i in range(60)]
    rows += [(2000, "small", "vi", "note", "một mình", 0, 0), (2001, None, "vi", "note", "không nguồn", 0, 0), (2002, "big", "vi", "note", None, 0, 0), (2003, "sm_all", "vi", "note", "từ khác 0 " * 30, 0, 0)]
    docs, targets = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("big", 0.5, 1), ("sm_all", 0.5, 3)], TARGETS)
    chosen, shares, marginals = mixing.mixed(docs, targets)
    out = chosen.collect()
    assert all(1 <= r.repeats <= {"big": 1, "sm_all": 3}[r.source] for r in out) and 2003 not in {r.doc_id for r in out}
    got = {r.source: r.actual_share for r in shares.collect()}
    assert got["big"] == pytest.approx(0.5, abs=0.02) and got["sm_all"] == pytest.approx(0.5, abs=0.02) and got["small"] == 0
    again = {(r.doc_id, r.repeats) for r in mixing.mixed(docs.repartition(7), targets)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in out}
    told = {(r.dimension, r.value): (r.n_tokens, r.share, r.actual_share) for r in marginals.collect()}
    used = sum(r.tokens * r.repeats for r in out)
    assert told["lang", "vi"][0] == sum(r.tokens * r.repeats for r in out if r.lang == "vi") and sum(x[2] for k, x in told.items() if k[0] == "topic") == pytest.approx(1)
    assert sum(x[0] for k, x in told.items() if k[0] == "lang") == used
    rare = {(r.doc_id, r.repeats) for r in mixing.mixed(docs, targets, least_value=0.9)[0].collect()}
    assert sum(r for _, r in rare) > 0
    empty, nothing, none = mixing.mixed(docs.where("false"), targets)
    assert none.count() == 0
    assert empty.count() == 0 and {r.source for r in nothing.collect()} == {"big", "sm_all"}


def test_truncation(spark):
    prose = "Bệnh nhân vào viện vì đau bụng khoảng {} ngày nay, kèm vã mồ hôi."
    whole = [f"{prose.format(i)}\n- đau bụng\n- vã mồ hôi\n{end}" for i in range(40) for end in ("Hết phiếu", "Bác sĩ điều trị đã ký", "- đau bụng", prose.format(3), "Chúc bạn mau khỏe…")]
    cut = {900: "x. " + prose.format(3)[:-20], 901: "a.\n" + prose.format(5)[:44], 902: "a.\n- vã mồ h", 903: "a.\nBác sĩ điều trị", 904: "a.\nBệnh nhân vào viện vì đau bụ…", 905: prose.format(9)[:-1]}
    kept = {950: "a.\n- đau bụng", 951: "b.\nHết phiếu\n------", 952: "Đau.", 953: "a.\nChúc bạn mau khỏe…"}
    rows = [(i, "s", t, "clash", True) for i, t in enumerate(whole)] + [(i, "s", t, "", False) for i, t in (cut | kept).items()] + [(990, "s", None, "", None), (991, None, "", "", None), (992, "s", "\n\n", "", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, word string, truncated boolean")
    got = {r.doc_id for r in truncation.ends(df).where("truncated").collect()}
    assert got == set(cut)
    assert truncation.ends(df.where("false")).count() == 0


@pytest.mark.parametrize("k", [2, 60])
def test_copies_of_a_truncated_text_do_not_vouch_for_each_other(spark, k):
    prose = "Bệnh nhân vào viện vì đau bụng khoảng {} ngày nay, kèm vã mồ hôi."
    whole = [f"{prose.format(i)}\n{end}" for i in range(40) for end in ("Hết phiếu", prose.format(3))]
    cut = ["a.\nHẹn tái khám theo lịch tại phòng", "b.\n" + prose.format(5)[:44]]  # a trigram found nowhere else; a word cut off
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(1000 + 100 * n + i, "s", t) for n, t in enumerate(cut) for i in range(k)] + [(1000, "s", cut[0])]
    out = truncation.ends(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r.doc_id for r in out if r.truncated} == {1100 + i for i in range(k)}
    assert {r.doc_id for r in out if r.truncated is None} == {1000 + i for i in range(k)}  # nothing is known of it, whatever its copies


def test_evidence_is_counted(spark):
    """Occurrences that go on against those that finish, at the bounds, and a word of any length that is cut."""
    long_word = "x" * 300
    inside = [f"{i} rất đau đầu nhiều hơn hôm qua." for i in range(8)] + [f"{i} mã {long_word} đã nhập." for i in range(3)]
    for n_final, truncated in ((2, True), (3, False)):  # 2 of 10 others finish: 0.2; 3 of 11: more
        rows = [*inside, *(f"{i} nữa\nrất đau đầu" for i in range(n_final)), "đang đo\nrất đau đầu", f"lại\nmã {long_word[:-5]}"]
        out = {r.doc_id: r.truncated for r in truncation.ends(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source")).collect()}
        assert out[len(rows) - 2] is truncated and out[len(rows) - 1] is True
