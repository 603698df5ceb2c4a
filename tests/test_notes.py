"""Lines, sections, roles, spans, proposals and flags."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG, SYMPTOM, TEST_NAME, TEST_RESULT
from ontospan.operators import assertions, chunking, notes, proposals, proposer, spans


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")


def test_lines_round_trip(spark):
    text = "a😀\n\nđau bụng\n"
    rows = notes.lines(docs(spark, text, None, "")).orderBy("doc_id", "line_no").collect()
    assert [r.line for r in rows if r.doc_id == 1] == text.split("\n")
    assert all(text[r.start : r.end] == r.line for r in rows if r.doc_id == 1)
    assert [(r.start, r.end) for r in rows if r.doc_id == 3] == [(0, 0)]


def test_sections(spark):
    text = "Phiếu\n1. Tiền sử bệnh: không\nx\n2. Bệnh sử hiện tại\ny\nĐiều trị: z"
    rows = notes.sections(docs(spark, text, "không có gì")).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.name, text[r.start : r.start + 2]) for r in rows if r.doc_id == 1] == [(1, "document", "Ph"), (1, "pre_admission", "1."), (1, "present_illness", "2.")]
    assert [(r.name, r.start, r.end) for r in rows if r.doc_id == 2] == [("document", 0, 11)]


def test_roles_and_advice(spark):
    text = "Hỏi: tôi đau bụng\nChẩn đoán: viêm\nbạn nên đi khám\nbạn nên nghỉ\nTrả lời: được"
    rows = notes.role_hits(docs(spark, text)).orderBy("start").collect()
    assert [r.role for r in rows] == ["question", "diagnosis", "answer", "answer"]


def test_cases(spark):
    text = "Mã số hồ sơ 1\nNgày xuất: 3\nMã số hồ sơ 2\nđau bụng\nHồ sơ thứ hai\nho"
    starts = [r.start for r in notes.case_starts(docs(spark, text)).orderBy("start").collect()]
    assert [text[s : s + 13] for s in starts] == ["Mã số hồ sơ 1", "Hồ sơ thứ hai"]


@pytest.mark.parametrize("n, found", [(19, 0), (20, 1)])
def test_repeated_runs(spark, n, found):
    assert notes.repeated_runs(docs(spark, "x " + "ho " * n + "y")).count() == found


def test_chunks_keep_their_invariants():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["đau bụng, ", "- ho\n", "\n\n", "x" * 90 + ". ", " ", "Khám: không sốt\n", "y" * 700]) for _ in range(rng.randint(0, 60)))
        spans_ = [x[:2] for x in chunking.chunks_of(text)]
        assert all(0 < e - s <= 650 and text[s:e].strip() == text[s:e] for s, e in spans_)
        assert all(a[1] <= b[0] for a, b in zip(spans_, spans_[1:]))
        assert "".join(text.split()) == "".join("".join(text[s:e].split()) for s, e in spans_)


def greedy_model(rows, order):
    kept = []
    for s, e, t, v in sorted((r for r in rows if r[0] < r[1]), key=order):
        if all(e <= y[0] or y[1] <= s for y in kept):
            kept.append((s, e, t, v))
    return sorted(kept)


def test_overlaps_against_a_model(spark):
    rng = random.Random(5)
    rows = [(d, s, s + rng.randint(0, 12), rng.choice([DIAGNOSIS, DRUG, SYMPTOM]), rng.choice([0.8, 0.95])) for d in range(30) for s in (rng.randint(0, 80) for _ in range(15))]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, type string, score double")
    got = spans.resolve_overlaps(df).collect()
    for d in range(30):
        expected = greedy_model([r[1:] for r in rows if r[0] == d], lambda r: (r[0] - r[1], spans.TYPE_RANK[r[2]], -r[3], r[0], r[2]))
        assert sorted((r.start, r.end, r.type, r.score) for r in got if r.doc_id == d) == expected


def test_merge_prefers_rules_and_counts(spark):
    rows = [(1, 0, 5, DRUG, 0.7, "rule"), (1, 0, 9, DRUG, 0.99, "llm"), (1, 6, 9, DRUG, 0.5, "llm"), (1, 6, 9, DRUG, 0.5, "llm"), (1, 4, 4, DRUG, 0.5, "llm")]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, type string, score double, source string")
    kept = spans.merge_proposals(df)
    assert sorted((r.start, r.end, r.source) for r in kept.collect()) == [(0, 5, "rule"), (6, 9, "llm")]
    s = spans.merge_summary(df, kept).first()
    assert (s.n_spans, s.n_invalid, s.n_duplicate, s.n_kept, s.n_overlap) == (5, 1, 1, 2, 1)


def test_relations_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(d, rng.randint(0, 900), rng.choice([DRUG, SYMPTOM, DIAGNOSIS, TEST_NAME, TEST_RESULT])) for d in range(5) for _ in range(30)]
    got = spans.relations(spark.createDataFrame(rows, "doc_id long, start int, type string")).count()
    assert got == sum(a[0] == b[0] and abs(a[1] - b[1]) <= 120 and (a[2] == DRUG and b[2] in (SYMPTOM, DIAGNOSIS) or a[2] == TEST_NAME and b[2] == TEST_RESULT) for a in rows for b in rows)


def test_lexicon_spans_are_whole_words(spark):
    lexicon = spark.createDataFrame([("ho", SYMPTOM), ("ho khan", SYMPTOM), ("α-gt", TEST_NAME)], "term string, concept_type string")
    text = "Ho khan, hoa ho\n😀 α-GT."
    rows = proposals.lexicon_spans(docs(spark, text), lexicon).orderBy("start", "end").collect()
    assert [text[r.start : r.end] for r in rows] == ["Ho", "Ho khan", "ho", "α-GT"]


def test_lab_and_order_lines(spark):
    text = "- Glucose: 5,6 mmol/L và CRP = 12 mg/L\n* Aspirin 81 mg x 2 viên sáng\nx 5 mg/dl"
    labs = proposals.lab_pairs(docs(spark, text)).orderBy("name_start").collect()
    assert [(r.name, r.result) for r in labs][0] == ("Glucose", "5,6 mmol/L")
    assert all(text[r.name_start :].startswith(r.name) and text[r.result_start :].startswith(r.result) for r in labs)
    orders = proposals.order_lines(docs(spark, text)).collect()
    assert [r.text for r in orders] == ["Aspirin 81 mg x 2 viên"] and text[orders[0].start :].startswith("Aspirin")


@pytest.mark.parametrize(
    "text, mention, kind, flags",
    [
        ("Bệnh nhân không sốt", "sốt", SYMPTOM, (True, False, False)),
        ("không ho nhưng sốt", "sốt", SYMPTOM, (False, False, False)),
        ("không điển hình sốt", "sốt", SYMPTOM, (False, False, False)),
        ("mẹ bị tiểu đường", "tiểu đường", DIAGNOSIS, (False, True, False)),
        ("tiền sử viêm gan", "viêm gan", DIAGNOSIS, (False, False, True)),
        ("không sốt " + "x" * 300, "sốt", SYMPTOM, (False, False, False)),
        ("không có glucose", "glucose", TEST_NAME, (False, False, False)),
    ],
)
def test_flags(spark, text, mention, kind, flags):
    s = text.index(mention)
    df = spark.createDataFrame([(text, s, s + len(mention), kind)], "text string, start int, end int, type string")
    r = assertions.with_flags(df).first()
    assert (r.negated, r.family, r.historical) == flags


@pytest.mark.parametrize(
    "raw, n",
    [('{"mentions": [["ho", "T"]]}', 1), ('```json\n{"entities": []}\n```', 0), ('ok: {"data": {"mentions": [1, 2]}} end', 2), ('{"a": [], "b": []}', None), ("nothing", None), ('{"result": [["x", "y"]]}', 1)],
)
def test_payloads(raw, n):
    found = proposer.mentions(proposer.salvage(raw))
    assert (None if found is None else len(found)) == n


def test_quotes_are_aligned():
    text = "Ho khan. ho  khan, SỐT"
    raw = json.dumps({"mentions": [["Ho khan", SYMPTOM], ["sốt", SYMPTOM], ["không có", SYMPTOM], ["x", "?"], ["", SYMPTOM], 5]})
    out = list(proposer.aligned(text, raw))
    assert [o[4] for o in out] == ["ok", "ok", "quote_not_found", "invalid_type", "empty_quote", "invalid_mention"]
    assert text[out[0][0] : out[0][1]] == "Ho khan" and text[out[1][0] : out[1][1]] == "SỐT"


def test_a_failing_proposer_does_not_fail_the_job(spark):
    def broken(chunks):
        raise OSError("down")

    df = spark.createDataFrame([(1, 1, 0, "ho")], "doc_id long, chunk_id long, start_pos int, text string")
    assert proposer.proposed(df, broken).first().reason == "failed: down"
    ok = proposer.proposed(df, proposer.lexicon_proposer({"ho": SYMPTOM})).first()
    assert (ok.start, ok.end, ok.type, ok.reason) == (0, 2, SYMPTOM, "ok")


def test_retry_after():
    assert proposer.retry_after("3", "") == 3 and proposer.retry_after(None, "try again in 350ms") == 0.35 and proposer.retry_after(None, "?") == 8


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert notes.sections(none).count() == notes.role_hits(none).count() == proposals.lab_spans(none).count() == chunking.split_chunks(none).count() == 0


def test_the_lexicon_proposer_quotes_all_terms_where_they_stand(spark, tmp_path):
    from ontospan.plans import note_queries

    text = "Ho khan, cho uống; HO nhiều. Suy tim"
    spark.createDataFrame([("ho khan", SYMPTOM, 90), ("ho", SYMPTOM, 80), ("suy tim", DIAGNOSIS, 1)], "term string, concept_type string, frequency long").write.parquet(str(tmp_path / "lexicon.parquet"))
    spark.createDataFrame([(1, 1, 10, text)], "doc_id long, chunk_id long, start_pos int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    rows = note_queries.lexicon_proposals(spark, str(tmp_path)).orderBy("start").collect()
    assert [(text[r.start - 10 : r.end - 10], r.start, r.type, r.reason) for r in rows] == [("Ho khan", 10, SYMPTOM, "ok"), ("HO", 29, SYMPTOM, "ok"), ("Suy tim", 39, DIAGNOSIS, "ok")]


def test_flags_know_the_part_and_the_case(spark):
    texts = ("Tiền sử gia đình:\nviêm gan", "Hồ sơ thứ nhất\nGhi nhận tiền sử phẫu thuật\nHồ sơ thứ hai\nsuy tim")
    df, names = docs(spark, *texts), ("viêm gan", "suy tim")
    rows = [(i, t.index(n), t.index(n) + len(n), DIAGNOSIS) for i, (t, n) in enumerate(zip(texts, names), 1)]
    placed = spark.createDataFrame(rows, "doc_id long, start int, end int, type string")
    parts = notes.with_parts(placed, df)
    flags = assertions.with_flags(parts.join(df, "doc_id"), "text", *(F.col(c) for c in ("role", "section", "case_start"))).orderBy("doc_id").collect()
    assert [(r.family, r.historical) for r in flags] == [(True, True), (False, False)]
    assert [r.case_start for r in flags] == [0, texts[1].index("Hồ sơ thứ hai")] and flags[0].role == "family_history"


def test_chunks_by_case_block_and_segment(spark):
    case = "Bệnh nhân vào viện vì ho.\nTiền sử bản thân:\n- hen\nThuốc: " + "sốt " * 25 + "hết\nDặn dò: tái khám"
    text = f"PHIẾU BÀN GIAO\nTrường hợp thứ nhất\n{case}\nTrường hợp thứ hai\n{case}"
    df = docs(spark, text, "  \n ", "Ngày xuất 3/4\nNgười nhận: A")
    rows = chunking.split_chunks(df).orderBy("doc_id", "chunk_no").collect()
    first = [r for r in rows if r.doc_id == 1]
    assert [r.chunk_id for r in first] == [f"c{i}" for i in range(1, len(first) + 1)]
    assert all(text[r.start_pos : r.end_pos] == r.text and r.text.strip() == r.text for r in first)
    assert not any("sốt sốt" in r.text for r in first) and sum("Dặn dò" in r.text for r in first) == 2  # the run is left out, the next line is not
    assert {r.context_scope.split(":")[0] for r in first} == {"case_2", "case_3"} and not any(r.text.startswith("PHIẾU") and "ho." not in r.text for r in first)
    assert all(r.context_before in ("", a.text[-240:]) for a, r in zip(first, first[1:]))
    assert not [r for r in rows if r.doc_id == 2] and [r.text for r in rows if r.doc_id == 3] == ["Ngày xuất 3/4\nNgười nhận: A"]
    cases = notes.case_bounds(df.where("doc_id = 1")).orderBy("case_no").collect()
    assert [r.case_no for r in cases] == [1, 2, 3] and cases[0].start == 0 and cases[-1].end == len(text)
    points = spark.createDataFrame([(1, text.index("hen")), (9, 0)], "doc_id long, at int")
    assert {(r.doc_id, r.section) for r in notes.section_at(points, df).collect()} == {(1, "document"), (9, "document")}


def test_long_groups_are_cut_at_breaks():
    text = "Câu một dài. " * 200
    spans_ = [x[:2] for x in chunking.chunks_of(text)]
    assert all(e - s <= 650 for s, e in spans_) and all(text[s:e].endswith(".") for s, e in spans_)
    assert chunking.units_of(" a \n\n  bc") == [(1, 2), (7, 9)] and chunking.segments("x " * 30, 0, 60) == [(0, 60)]


def test_orders_need_a_cue(spark):
    text = "Thuốc uống:\nAspirin 81 mg\nGalxi 5 mg/ml x 3 ống\nBromin A x 2 viên\nNatri 5 mg/l\n" + "z" * 150 + "\nKali 7 mg\n" + "z" * 120
    assert sorted(r.text for r in proposals.order_lines(docs(spark, text)).collect()) == ["Aspirin 81 mg", "Bromin A x 2 viên", "Galxi 5 mg/ml x 3 ống"]


def test_conditions_that_are_none(spark):
    text = "Chẩn đoán: suy tim.\nChẩn đoán: hình ảnh mờ.\nChẩn đoán là tham dò; Dx: khác\nChẩn đoán: " + "bệnh nhân rất mệt và đau nhiều ngày liền rồi mới vào đây"
    assert [r.text for r in proposals.cued_conditions(docs(spark, text)).collect()] == ["suy tim"]


def test_known_values_and_contextual_results(spark):
    lexicon = spark.createDataFrame([("creatinin máu", TEST_NAME), ("wb", TEST_NAME), ("tràn dịch", TEST_RESULT), ("nhịp xoang", TEST_RESULT)], "term string, concept_type string")
    text = "Creatinin máu (lần 2) là 5,6 mmol/L; wb: 3\nCreatinin máu chưa có\n"
    rows = proposals.known_values(docs(spark, text), lexicon).orderBy("start").collect()
    assert [(text[r.start : r.end], r.type) for r in rows] == [("Creatinin máu", TEST_NAME), ("5,6 mmol/L", TEST_RESULT)]
    texts = "Siêu âm: tràn dịch ít", "Tôi bị tràn dịch", "nhịp xoang đều"
    found = proposals.contextual_results(docs(spark, *texts), lexicon).orderBy("doc_id").collect()
    assert [(r.doc_id, texts[r.doc_id - 1][r.start : r.end]) for r in found] == [(1, "tràn dịch"), (3, "nhịp xoang")]


def test_terms_that_begin_with_a_sign_and_overlaps(spark):
    lexicon = spark.createDataFrame([("(-) test", TEST_NAME), ("ho ho", SYMPTOM), ("ho", SYMPTOM), ("ho", DIAGNOSIS), (None, DRUG), (" ", DRUG)], "term string, concept_type string")
    text = "a(-) test, (-) TEST\nho ho ho\nİ ho"
    got = sorted((text[r.start : r.end], r.type) for r in proposals.lexicon_spans(docs(spark, text), lexicon).collect())
    assert got == sorted([("(-) TEST", TEST_NAME), *[("ho ho", SYMPTOM)] * 2, *[("ho", SYMPTOM)] * 4, *[("ho", DIAGNOSIS)] * 4])
    assert proposals.lexicon_spans(docs(spark, text), lexicon.where("false")).count() == 0


def test_units_payload_and_best_mentions(spark):
    raw = json.dumps({"mentions": [{"quote": "ho", "type": SYMPTOM, "unit_id": "c1u2"}, {"quote": "ho", "type": SYMPTOM, "unit_id": "c1u9"}, {"quote": "ho", "type": SYMPTOM, "confidence": 0.9}]})
    text = "ho\nsốt, ho"
    assert [(o[0], o[4]) for o in proposer.aligned(text, raw, chunking.units_of(text))][:2] == [(8, "ok"), (None, "invalid_unit_id")]
    df = spark.createDataFrame([("d", "c", 5, text, "answer")], "doc_id string, chunk_id string, start_pos int, text string, structure_role string")
    one = proposer.payload(df.first().asDict())
    assert one["policy"] == proposer.ROLE_POLICY["answer"] and [u["text"] for u in one["units"]] == ["ho", "sốt, ho"] and one["context_before"] == ""
    said = proposer.proposed(df, proposer.replay_proposer({text: raw}))
    assert {r.reason for r in proposer.rejections(said).collect()} >= {"ok", "invalid_unit_id"}
    both = spark.createDataFrame([(1, 0, 2, SYMPTOM, 0.5), (1, 0, 2, SYMPTOM, 0.9), (1, 0, 2, DRUG, 0.1)], "doc_id long, start int, end int, type string, score double")
    assert {(r.type, r.score) for r in proposer.best_mentions(both).collect()} == {(SYMPTOM, 0.9), (DRUG, 0.1)}
    rows = chunking.units(df).orderBy("unit_no").collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(5, 7, "ho"), (8, 15, "sốt, ho")]
