"""Edits, replaced codes, transfer, and blocks."""

from ontospan.operators import curation, notes


def test_edits(spark):
    concepts = spark.createDataFrame([(1, 0, 3, "A", ["x"]), (1, 5, 8, "A", None)], "doc_id long, start int, end int, type string, candidates array<string>")
    edits = [(1, 0, 3, "update", "B", None, 1), (1, 5, 8, "update", "C", ["y"], 1), (1, 5, 8, "remove", None, None, 2), (1, 2, 4, "add", "D", None, 1), (1, 20, 22, "add", "E", ["z"], 1), (2, 0, 1, "remove", None, None, 1)]
    out = curation.edited(concepts, spark.createDataFrame(edits, "doc_id long, start int, end int, action string, type string, candidates array<string>, edit_no int"))
    assert sorted((r.start, r.type, r.candidates) for r in out.collect()) == [(0, "B", ["x"]), (20, "E", ["z"])]


def test_replaced_codes(spark):
    concepts = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "concept_id long, candidates array<string>")
    out = curation.replaced_codes(concepts, spark.createDataFrame([("a", "b"), ("q", "r")], "old_code string, new_code string"))
    assert {r.concept_id: r.candidates for r in out.collect()} == {1: ["b"], 2: [], 3: None}


def test_transfer(spark):
    old, new = "Bệnh nhân đau bụng nhiều ngày. Hết.", "Thêm. Bệnh nhân  đau bụng nhiều, ngày nay."
    s = old.index("đau bụng")
    rows = [(1, old, new, [{"start": s, "end": s + 8}, {"start": old.index("Hết"), "end": old.index("Hết") + 3}]), (2, None, new, [])]
    out = curation.transferred(spark.createDataFrame(rows, "doc_id long, old_text string, new_text string, spans array<struct<start:int,end:int>>")).collect()
    assert [new[r.start : r.end] for r in out] == ["đau bụng"]


def test_heading_only_blocks_join_the_next(spark):
    text = "Câu hỏi: đau?\nXét nghiệm:\nĐiều trị:\nuống thuốc\nChẩn đoán: viêm gan"
    blocks = notes.structural_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.role, text[r.start : r.start + 6]) for r in blocks] == [("question", "Câu hỏ"), ("treatment", "Xét ng"), ("diagnosis", "Chẩn đ")]
    assert all(a.end == b.start for a, b in zip(blocks, blocks[1:])) and blocks[-1].end == len(text)


def test_overlapping_adds(spark):
    concepts = spark.createDataFrame([], "doc_id long, start int, end int, type string, candidates array<string>")
    edits = [(1, 0, 5, "add", "A", None, 1), (1, 3, 8, "add", "B", None, 2), (1, 8, 9, "add", "C", None, 3), (2, 3, 8, "add", "D", None, 4)]
    out = curation.edited(concepts, spark.createDataFrame(edits, "doc_id long, start int, end int, action string, type string, candidates array<string>, edit_no int"))
    assert sorted((r.doc_id, r.type) for r in out.collect()) == [(1, "A"), (1, "C"), (2, "D")]
