import json

import pytest
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG, SYMPTOM, Settings
from ontospan.operators import proposer
from ontospan.operators.policy import Rule
from ontospan.plans import pipeline


def inputs(spark, texts):
    lexicon = spark.createDataFrame([("ho", SYMPTOM), ("suy tim", DIAGNOSIS), ("viêm gan b", DIAGNOSIS), ("hen", DIAGNOSIS), ("sốt", SYMPTOM), ("galxi 5 mg", DRUG)], "term string, concept_type string")
    kb = spark.read.parquet("/root/testdata/sf0.001/kb_records.parquet")
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string"), lexicon, kb


def test_annotated_runs_all_stages(spark):
    docs, lexicon, kb = inputs(spark, {1: "Bệnh nhân ho.\nTrả lời: bạn bị suy tim", 2: "Chẩn đoán: suy tim", 3: "Chẩn đoán: suy tim " + "rất mệt mỏi " * 20, 4: None, 5: ""})
    rules = spark.createDataFrame([(DIAGNOSIS, "suy tim", "short_line", None, ["X1"])], "concept_type string, alias_norm string, profile string, assertions array<string>, candidates array<string>")
    ask = proposer.lexicon_proposer({"ho": SYMPTOM})
    rows = pipeline.annotated(docs, lexicon, kb, ask, tables=pipeline.Tables(policy=rules)).collect()
    got = {(r.doc_id, r.text): r.candidates for r in rows}
    assert {t for d, t in got if d == 1} == {"ho"}  # an answer's rule spans need the second proposer
    assert got[2, "suy tim"] == ["X1"]  # the emission policy
    # the longest rule span, and no code for a long name
    assert [(t.split()[0], len(t.split()), c) for (d, t), c in got.items() if d == 3] == [("suy", 62, [])]
    assert all(r.problems == [] for r in rows)


def test_parts_of_a_note_and_rule_tables(spark):
    texts = {
        1: "Tiền sử gia đình:\nMẹ bị hen\nTiền sử bản thân:\nViêm gan B\nLý do nhập viện:\nho, không sốt",
        2: "Trường hợp thứ nhất\nBệnh nhân suy tim, không sốt\nTrường hợp thứ hai\nBệnh nhân ho",
    }
    docs, lexicon, kb = inputs(spark, texts)
    tables = pipeline.Tables(
        drops=[Rule("noise", (SYMPTOM,), {"mention": "^sot$", "before": "khong$"}, {"line": "suy tim"})],
        called_for=[Rule("Z9", (DIAGNOSIS,), {"mention": "^viem gan b$"}, {"historical": "true"}), Rule("Z8", (DIAGNOSIS,), {"mention": "^suy tim$", "wide": "benh nhan"})],
        overrides=spark.createDataFrame([(DIAGNOSIS, "suy tim", "O1"), (DIAGNOSIS, "viem gan b", "O2")], "concept_type string, alias_norm string, code string"),
        rejected=spark.createDataFrame([(DIAGNOSIS, "hen")], "concept_type string, alias_norm string"),
    )
    rows = {(r.doc_id, r.text): r for r in pipeline.annotated(docs, lexicon, kb, tables=tables).collect()}
    assert set(rows) == {(1, "hen"), (1, "Viêm gan B"), (1, "ho"), (2, "suy tim"), (2, "ho"), (2, "sốt")}  # the rule drops the first fever alone
    assert "isFamily" in rows[1, "hen"].assertions and "isHistorical" in rows[1, "Viêm gan B"].assertions and rows[1, "ho"].assertions == []
    assert rows[1, "Viêm gan B"].candidates == ["O2"] and rows[2, "suy tim"].candidates == ["Z8"] and rows[1, "hen"].candidates == []
    assert rows[2, "sốt"].assertions == ["isNegated"] and rows[2, "ho"].assertions == []


def test_repair_and_profiles(spark):
    docs, lexicon, kb = inputs(spark, {1: "Chẩn đoán: suy tim", 2: "Chẩn đoán: viêm gan b"})
    rule = spark.createDataFrame([(DIAGNOSIS, "suy tim", "short_line", None, [])], "concept_type string, alias_norm string, profile string, assertions array<string>, candidates array<string>")
    profiles = spark.createDataFrame([(DIAGNOSIS, "viem gan b", "short_line", ["P1", "P2"])], "concept_type string, alias_norm string, profile string, codes array<string>")
    overrides = spark.createDataFrame([(DIAGNOSIS, "suy tim", "O1")], "concept_type string, alias_norm string, code string")
    tables = pipeline.Tables(policy=rule, profiles=profiles, overrides=overrides)
    run = lambda repair: {r.text: r.candidates for r in pipeline.annotated(docs, lexicon, kb, settings=Settings(repair_empty_candidates=repair), tables=tables).collect()}
    assert run(False) == {"suy tim": [], "viêm gan b": ["P1", "P2"]}
    assert run(True) == {"suy tim": ["O1"], "viêm gan b": ["P1", "P2"]}  # repair looks codes up again, whatever the policy said


def test_string_ids_and_no_notes(spark):
    docs, lexicon, kb = inputs(spark, {1: "ho"})
    named = docs.select(F.lit("n1").alias("doc_id"), "text")
    assert [(r.doc_id, r.text) for r in pipeline.annotated(named, lexicon, kb).collect()] == [("n1", "ho")]
    assert pipeline.annotated(docs.where("false"), lexicon, kb).count() == 0


def test_a_note_without_an_answer_is_an_error(spark):
    docs, lexicon, kb = inputs(spark, {1: "Trả lời: bạn bị suy tim", 2: "Chẩn đoán: suy tim"})
    whole = proposer.lexicon_proposer({"suy tim": DIAGNOSIS})

    def down(chunks):
        raise OSError("down")

    for ask, why in (
        (down, "2 notes .*note 1: failed: down"),
        (lambda chunks: whole(chunks)[1:], "failed: 0 answers to 1 chunks|failed: 1 answers to 2 chunks"),
        (lambda chunks: ["" if c["text"].startswith("Trả lời") else a for c, a in zip(chunks, whole(chunks))], "1 notes .*note 1: no_payload"),
    ):
        with pytest.raises(RuntimeError, match=why):
            pipeline.annotated(docs, lexicon, kb, ask)
    # a rejected mention is an answer, and so is none at all
    said = lambda quotes: {(r.doc_id, r.text) for r in pipeline.annotated(docs, lexicon, kb, lambda chunks: [json.dumps({"mentions": quotes})] * len(chunks)).collect()}
    assert said([["suy tim", DIAGNOSIS], ["không có", SYMPTOM]]) == {(1, "suy tim"), (2, "suy tim")} and said([]) == {(2, "suy tim")}
