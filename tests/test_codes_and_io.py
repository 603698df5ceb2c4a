"""Terminology, retrieval, policy, evaluation, learning, readers, writers, stream."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG, SYMPTOM
from ontospan import config, predict
from ontospan.operators import evaluate, learn, policy, proposer, retrieval, terminology
from ontospan.sources import readers, writers
from ontospan.streaming import notes as streaming

KB = "record_id long, code string, concept_type string, record_name string, name_vi string, name_en string, priority int, archived boolean, ttys array<string>, aliases array<string>, alias_norms array<string>"


@pytest.fixture(scope="module")
def kb(spark):
    rows = [
        (1, "J44", DIAGNOSIS, "bệnh phổi tắc nghẽn mạn tính", None, None, 10, False, None, ["copd"], None),
        (2, "J45", DIAGNOSIS, "hen phế quản", None, "asthma", 10, False, None, [], []),
        (3, "J46", DIAGNOSIS, "hen phế quản cấp tính", None, None, 20, False, None, None, None),
        (4, "100", DRUG, "aspirin 81 MG Oral Tablet", None, None, 5, False, ["SCD"], ["asa 81 mg"], None),
        (5, "101", DRUG, "aspirin 325 MG Oral Tablet", None, None, 5, False, ["SCD"], None, None),
        (6, "102", DRUG, "aspirin", None, None, 5, False, ["IN"], None, None),
    ]
    return spark.createDataFrame(rows, KB)


def codes(spark, kb, *mentions):
    df = spark.createDataFrame(list(mentions), "concept_type string, text string")
    return {(r.concept_type, r.text): r.code for r in retrieval.select_codes(retrieval.lookup(df, kb), kb).collect()}


def test_selection(spark, kb):
    got = codes(spark, kb, (DIAGNOSIS, "COPD"), (DIAGNOSIS, "chẩn đoán hen phế quản"), (DIAGNOSIS, "gãy xương"), (DRUG, "Aspirin 81mg po qd"), (DRUG, "aspirin 500 mg"), (DRUG, "ASA 325 mg"), (DIAGNOSIS, ""))
    assert got == {(DIAGNOSIS, "COPD"): "J44", (DIAGNOSIS, "chẩn đoán hen phế quản"): "J45", (DRUG, "Aspirin 81mg po qd"): "100", (DRUG, "ASA 325 mg"): "101"}


def test_aliases_are_ranked(spark, kb):
    more = kb.unionByName(spark.createDataFrame([(9, "Z9", DIAGNOSIS, "COPD", None, None, 1, False, None, None, None)], KB))
    rows = terminology.alias_index(more).where("alias_norm = 'copd'").orderBy("rank").collect()
    assert [(r.rank, r.code) for r in rows] == [(0, "Z9"), (1, "J44")]


def test_grouped_records(spark):
    rows = [("1", "Tylenol", "BN", True, 5, False), ("1", "acetaminophen 500 MG", "SCD", False, 2, False), ("1", "apap", "SY", False, 9, True)]
    r = terminology.grouped_records(spark.createDataFrame(rows, "code string, name string, tty string, preferred boolean, priority int, archived boolean")).first()
    assert (r.record_name, r.priority, r.archived, r.ttys) == ("acetaminophen 500 MG", 2, True, ["BN", "SCD", "SY"])


def test_policy_exact_wildcard_abstain(spark):
    rules = [(DRUG, "A", "short_line", None, ["w"], 1), (DRUG, "a", "short_line", ["f"], [], 2), (DRUG, "a", "short_line", None, ["w2"], 3), ("X", "a", "short_line", None, ["no"], 4), (DRUG, "", "short_line", None, ["no"], 5)]
    table = policy.rules(spark.createDataFrame(rules, "concept_type string, alias_norm string, profile string, assertions array<string>, candidates array<string>, rule_no int"))
    concepts = [(1, DRUG, "a", "short_line", ["f", "f"], ["c"]), (2, DRUG, "a", "short_line", [], ["c"]), (3, DRUG, "a", "long_line", None, ["c"]), (4, DRUG, "b", "short_line", None, None)]
    out = policy.applied(spark.createDataFrame(concepts, "i int, concept_type string, alias_norm string, profile string, assertions array<string>, candidates array<string>"), table)
    assert {r.i: r.emitted for r in out.collect()} == {1: [], 2: ["w2"], 3: ["c"], 4: None}


GOLD = "doc_id long, idx int, type string, start int, end int, text string, assertions array<string>, candidates array<string>"


def test_identical_sets_score_100(spark):
    rows = [(1, 0, DRUG, 0, 5, "aspirin", [], ["1"]), (1, 1, SYMPTOM, 6, 9, "ho", ["isNegated"], None), (2, 0, SYMPTOM, 0, 2, "ho", [], None)]
    gold = spark.createDataFrame(rows, GOLD)
    scores = evaluate.corpus_score(evaluate.document_scores(gold, gold, evaluate.greedy_match(evaluate.scored_pairs(gold, gold)))).first()
    assert (scores.text_score, scores.assertion_score, scores.candidate_score, scores.final_score) == (100, 100, 100, 100)
    counts = evaluate.precision_recall(evaluate.bag_counts(gold, gold, ["doc_id"], ["type", "start", "end"])).collect()
    assert all(r.f1 == 1 for r in counts)


def test_missing_extra_and_text_only(spark):
    gold = spark.createDataFrame([(1, 0, SYMPTOM, 0, 10, "đau bụng dữ dội", [], None), (1, 1, SYMPTOM, 20, 22, "ho", [], None)], GOLD)
    predicted = spark.createDataFrame([(1, 0, SYMPTOM, 500, 510, "Đau bụng dữ dội", [], None), (1, 1, DRUG, 20, 22, "ho", [], None)], GOLD)
    matches = evaluate.greedy_match(evaluate.scored_pairs(gold, predicted))
    assert [(r.gold_index, r.pred_index) for r in matches.collect()] == [(0, 0)]
    r = evaluate.document_scores(gold, predicted, matches).first()
    assert (r.matched, r.missing, r.extra) == (1, 1, 1)


def test_bags_are_multisets(spark):
    g, p = (spark.createDataFrame([(1, x) for x in xs], "d int, x string") for xs in ("aab", "abbc"))
    r = evaluate.bag_counts(g, p, ["d"], ["x"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 2, 1)


def test_preferred_sets_abstain_on_ties(spark):
    rows = [("t", "a", ["x"], 3), ("t", "a", [], 1), ("t", "b", ["x"], 1), ("t", "b", ["y"], 1)]
    out = learn.preferred_sets(spark.createDataFrame(rows, "concept_type string, alias_norm string, codes array<string>, support long"))
    assert {r.alias_norm: r.codes for r in out.collect()} == {"a": ["x"], "b": None}


def test_readers(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/note10.txt").write_bytes("﻿đau bụng".encode())
    (tmp_path / "n/note2.txt").write_bytes("Bệnh".encode("cp1258", errors="ignore"))
    (tmp_path / "n/x.txt").write_bytes(b"caf\xe9 \xd2")
    rows = {r.name: r.text for r in readers.read_notes(spark, str(tmp_path / "n")).collect()}
    assert rows["note10"] == "đau bụng" and rows["x"].startswith("caf") and len(rows) == 3
    assert [r.name for r in readers.read_notes(spark, str(tmp_path / "n"), limit=2).collect()] == ["note2", "note10"]
    (tmp_path / "kb.jsonl").write_text('﻿{"code": "A1", "name": "x", "ttys": ["IN"]}\n\nbroken\n{"name": "no code"}\n')
    assert [(r.code, r.ttys) for r in readers.read_kb(spark, str(tmp_path / "kb.jsonl")).collect()] == [("A1", ["IN"])]
    fields = [""] * 18
    for i, v in {0: "7", 1: "ENG", 6: "Y", 11: "RXNORM", 12: "SCD", 14: "aspirin 81 MG", 16: "N"}.items():
        fields[i] = v
    (tmp_path / "c.rrf").write_text("|".join(fields) + "\n" + "|".join(fields).replace("ENG", "SPA") + "\nshort|row\n")
    assert [(r.code, r.tty, r.preferred) for r in readers.read_rrf(spark, str(tmp_path / "c.rrf")).collect()] == [("7", "SCD", True)]
    (tmp_path / "o.csv").write_text("RXCUI,Term,Aliases\n5,aspirin,asa; acetyl|x\n,none,\n")
    assert [(r.code, r.name, r.aliases) for r in readers.read_ontology_csv(spark, str(tmp_path / "o.csv"), "RxNorm").collect()] == [("5", "aspirin", ["asa", "acetyl", "x"])]
    (tmp_path / "o.txt").write_text("J45  hen phế quản \n\n")
    assert [(r.code, r.name) for r in readers.read_ontology_txt(spark, str(tmp_path / "o.txt"), "ICD10").collect()] == [("J45", "hen phế quản")]
    for content in ([{"id": "1", "term": "a"}], {"entries": [{"code": "1", "name": "a"}]}):
        (tmp_path / "o.json").write_text(json.dumps(content))
        assert [(r.code, r.name) for r in readers.read_ontology_json(spark, str(tmp_path / "o.json"), "S").collect()] == [("1", "a")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "A00 x\nA01 y")
    assert readers.read_zipped_lines(spark, str(tmp_path / "z.zip")).count() == 2


def test_files_round_trip(spark, tmp_path):
    rows = [(1, 5, 8, "sốt", SYMPTOM, ["isNegated"], None), (1, 0, 3, "asa", DRUG, [], ["100"]), (2, 0, 2, "ho", SYMPTOM, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, text string, type string, assertions array<string>, candidates array<string>")
    writers.write_files(df, str(tmp_path / "out"))
    one = json.loads((tmp_path / "out/1.json").read_text())
    assert [c["text"] for c in one] == ["asa", "sốt"] and one[0]["candidates"] == ["100"] and "candidates" not in one[1]
    back = readers.read_concepts(spark, str(tmp_path / "out")).where("name = '1'").orderBy("idx").collect()
    assert [(r.text, list(r.position)) for r in back] == [("asa", [0, 3]), ("sốt", [5, 8])]
    assert writers.concept_rows(df.where("false")).count() == 0


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "ho, sốt")], "doc_id long, text string").withColumn("received_at", F.lit("2030-01-01 10:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    lexicon = spark.createDataFrame([("ho", SYMPTOM)], "term string, concept_type string")
    counts = streaming.lexicon_counts(streaming.note_stream(spark, str(tmp_path / "in")), lexicon)
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.type, r.n) for r in spark.sql("SELECT * FROM counted").collect()] == [(SYMPTOM, 1)]


def test_ontology_folder_and_stages(spark, tmp_path):
    (tmp_path / "rx_names.csv").write_text("rxcui,name,aliases\n5,aspirin 81 mg,asa|acetyl\n6,warfarin,\n")
    (tmp_path / "icd.txt").write_text("J45 hen phế quản\n")
    (tmp_path / "other.txt").write_text("X no\n")
    (tmp_path / "icd2.json").write_text(json.dumps([{"code": "J45", "name": "hen phế quản nặng"}]))
    rows = readers.read_ontology_folder(spark, str(tmp_path))
    assert {(r.system, r.code) for r in rows.collect()} == {("RxNorm", "5"), ("RxNorm", "6"), ("ICD10", "J45")} and readers.read_ontology_folder(spark, str(tmp_path / "no")).count() == 0
    of = lambda system, kind: rows.where(F.col("system") == system).withColumn("concept_type", F.lit(kind)).withColumn("priority", F.lit(1))
    index = terminology.ontology_index([of("RxNorm", DRUG), of("ICD10", DIAGNOSIS).where("name = 'hen phế quản'"), of("ICD10", DIAGNOSIS).where("name <> 'hen phế quản'")])
    assert {(r.code, r.name) for r in index.collect()} == {("5", "aspirin 81 mg"), ("6", "warfarin"), ("J45", "hen phế quản nặng")}
    asked = [(DRUG, "ASA"), (DRUG, "aspirin 81 mg po"), (DRUG, "warfarin 5 mg"), (DIAGNOSIS, "hen phế quản năng x"), (DIAGNOSIS, "gãy tay"), (DRUG, None), (DRUG, "?")]
    got = {r.text: (r.stage, r.code) for r in terminology.ontology_lookup(spark.createDataFrame(asked, "concept_type string, text string"), index, DRUG).collect()}
    assert got == {"ASA": ("exact", "5"), "aspirin 81 mg po": ("without_dose", "5"), "warfarin 5 mg": ("without_form", "6"), "hen phế quản năng x": ("fuzzy", "J45")}
    assert readers.ontology_or(spark, str(tmp_path / "no"), index).count() == 3
    index.write.parquet(str(tmp_path / "index"))
    assert readers.ontology_or(spark, str(tmp_path / "index"), index.where("false")).count() == 3


def test_likeness_loses_no_pair(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(11)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(5, 30))).strip() or "abcde" for _ in range(60)]
    other = [b[:i] + rng.choice(["", "x", "ab"]) + b[i + rng.choice([0, 1]) :] for b in base for i in (rng.randint(0, len(b)),)]
    df = lambda xs: spark.createDataFrame([("k", x) for x in set(xs)], "concept_type string, key string")
    got = {(r.query, r.other) for r in terminology.alike(df(base), df(other), 0.88).collect()}
    expected = {(a, b) for a in base for b in other if len(a) >= 5 and len(b) >= 3 and SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert got == expected and len(got) > 20


def test_likeness_at_the_least_ratio_and_spread(spark):
    # 22 of 25 characters in 7 blocks with 8 runs of three in common, the fewest that a ratio of 0.88 leaves
    a, b = "abcd1efghij2klmnop3qrstuv", "abcdefg4hijklm5nopqrs6tuv"
    df = lambda xs: spark.createDataFrame(xs, "concept_type string, key string")
    left, right = df([("k", a), ("k", a), ("o", a), (None, a), ("k", "abcd"), ("k", "x" * 300)]), df([("k", b), ("k", b), ("p", b), (None, b), ("k", "ab"), ("k", "x" * 300)])
    found = terminology.alike(left, right, 0.88)
    assert sorted(tuple(r) for r in found.collect()) == [("k", a, b, 0.88), ("k", "x" * 300, "x" * 300, 1.0)]
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert terminology.alike(left, right.where("false"), 0.88).count() == 0 and terminology.alike(left.where("false"), right, 0.88).count() == 0


def test_likeness_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(terminology, "BLOCK_KEYS", 2)
    df = lambda xs: spark.createDataFrame([("k", x) for x in xs], "concept_type string, key string")
    keys = ["viem phoi man", "viem phoi nang", "gay xuong tay", "hen phe quan", "suy tim trai"]
    assert {r.other for r in terminology.alike(df(keys), df(keys), 0.99).collect()} == set(keys)


def test_search_is_spread_and_has_no_use_for_its_broadcast(spark, monkeypatch):
    names = ["viem phoi man tinh", "viem phoi nang", "gay xuong tay", "hen phe quan", "suy tim trai"]
    rows = [(DIAGNOSIS, f"C{i}", n, None, None, 1, [], [], []) for i, n in enumerate(names)]
    kb = spark.createDataFrame(rows, "concept_type string, code string, record_name string, name_vi string, name_en string, priority int, aliases array<string>, alias_norms array<string>, ttys array<string>").withColumn("record_id", F.col("code"))
    docs = terminology.condition_documents(kb, DIAGNOSIS)
    found = retrieval.preliminary(spark.createDataFrame([(n + "x",) for n in names], "query string"), docs)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = spark.createDataFrame([(DIAGNOSIS, n + "x") for n in names], "concept_type string, text string")
    hits = lambda: sorted((r.text, r.code, round(r.score, 9)) for r in retrieval.lexical_hits(asked, kb).collect())
    first = hits()
    assert {(f"{n}x", f"C{i}") for i, n in enumerate(names)} <= {x[:2] for x in first}
    monkeypatch.setattr(retrieval, "SMALL_DOCS", 2)
    assert hits() == first
    assert policy.looked_at([policy.Rule("r", (), {"line": "a"}, {"wide": "b"})], ()) == {"line", "wide"}


def test_curated_canonical_and_knowledge(spark, kb):
    lexicon = spark.createDataFrame([(DIAGNOSIS, "khó thở", None, "J45", 3), (DIAGNOSIS, "khó thở", None, "J44", 9), (DIAGNOSIS, "khó thở", None, "J46", 1), (DIAGNOSIS, "khó thở", "short_line", "J46", 2)], "concept_type string, alias_norm string, profile string, code string, file_support long")
    lexicon = lexicon.withColumn("alias_norm", F.lit("kho tho"))
    given = spark.createDataFrame([(DIAGNOSIS, "copd", 0, "Z1", 1)], "concept_type string, alias_norm string, rank int, code string, priority int")
    index, curated, profiles = retrieval.knowledge(kb, given, lexicon, least_files=2)
    assert [(r.code,) for r in index.where("alias_norm = 'copd'").collect()] == [("Z1",)]
    assert [r.code for r in curated.orderBy("rank").collect()] == ["J44", "J45"] and [r.codes for r in profiles.collect()] == [["J46"]]
    asked = spark.createDataFrame([(DIAGNOSIS, "Khó thở"), (DIAGNOSIS, "mắc bệnh suyễn")], "concept_type string, text string")
    canonical = spark.createDataFrame([("suyen", "hen phe quan")], "alias_norm string, canonical string")
    hits = retrieval.lookup(asked, kb, curated=curated, canonical=canonical)
    top = {r.text: (r.code, r.source) for r in hits.where("hit_rank = 1").collect()}
    assert top == {"Khó thở": ("J44", "curated"), "mắc bệnh suyễn": ("J45", "diagnosis_canonical")}
    assert {r.text: r.code for r in retrieval.select_codes(hits, kb).collect()} == {"Khó thở": "J44", "mắc bệnh suyễn": "J45"}
    with_profile = asked.withColumn("profile", F.lit("short_line"))
    assert {r.text: r.profile_codes for r in retrieval.profile_codes(with_profile, profiles).collect()} == {"Khó thở": ["J46"], "mắc bệnh suyễn": None}
    assert retrieval.candidate_rows(hits, kb).where("hit_rank = 1 AND record_name IS NULL").count() == 0


def test_predict_settings_and_manifest(spark, kb, tmp_path, monkeypatch):
    lexicon = spark.createDataFrame([("ho", SYMPTOM)], "term string, concept_type string")
    out = predict.predict_batch(spark, ["Bệnh nhân ho", "không gì"], lexicon, kb)
    assert [[(c["text"], c["position"]) for c in x] for x in out] == [[("ho", [10, 12])], []]
    with pytest.raises(ValueError):
        predict.predict(spark, "", lexicon, kb)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/n1.txt").write_text("ho")
    assert predict.predict_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), lexicon, kb) == {"notes": 1} and json.loads((tmp_path / "out/n1.json").read_text())[0]["text"] == "ho"
    monkeypatch.setenv("ONTOSPAN_CHUNK_CHARS", "x")
    monkeypatch.setenv("ONTOSPAN_REPAIR", "no")
    assert config.Settings.from_env() == config.Settings(repair_empty_candidates=False)
    assert config.input_folder(str(tmp_path)).endswith("test_inputs")
    writers.write_manifest(str(tmp_path / "m.json"), {"n": str(tmp_path / "in/n1.txt")}, {"rows": 1})
    assert json.loads((tmp_path / "m.json").read_text())["files"]["n"]["sha256"] == readers.checksum(str(tmp_path / "in/n1.txt"))
    assert writers.status_report({"lexicon": lexicon}).endswith("| lexicon | 1 |")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    assert readers.read_zipped_lines(spark, str(tmp_path / "bad.zip")).count() == 0
    assert proposer.cut_off("length", "") and proposer.cut_off(None, "max_tokens reached") and not proposer.cut_off("stop", "max_tokens") and not proposer.healthy("http://127.0.0.1:9/")
    assert "response_format" not in proposer.chat("m", "p", {}, 5, False)


def test_mapping_stats_and_reports(spark):
    rows = [("t", "a", "x", ["1"], ["1"], ["1"], True, "exact", "f"), ("t", "a", "y", ["2"], [], ["3", "2"], True, "selector_abstain", "f"), ("t", "b", "z", [], [], None, False, "correct_abstain", "g"), ("t", "b", "z", None, ["4"], [], False, "false_positive", "h")]
    df = spark.createDataFrame(rows, "type string, profile string, text string, expected array<string>, predicted array<string>, hits array<string>, known boolean, outcome string, file string")
    whole = evaluate.mapping_stats(df, ["type", "profile"]).where("type IS NULL").first()
    assert (whole.n, whole.hit_1, whole.hit_5, whole.coverage) == (4, 0.5, 1.0, 1.0) and whole.baseline == round(2 / 6, 6) and whole.weighted_jaccard == round(3 / 6, 6)
    assert [(r.text, r.outcome) for r in evaluate.top_errors(df).collect()] == [("y", "selector_abstain"), ("z", "false_positive")]
    assert [(r.file, r.weighted_jaccard) for r in evaluate.worst_files(df).collect()] == [("h", 0.0), ("f", 0.5)]
    assert evaluate.mapping_stats(df.where("false"), ["type"]).count() <= 1
