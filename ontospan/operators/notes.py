"""Notes as lines, sections, roles and cases, with offsets in Unicode characters.

Lines and their offsets are worked out within the row; only the few lines that are headings are shuffled, by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontospan.functions.text import normalize_key

# Headings by section, in folded form.
MAJOR = {
    "pre_admission": ("1", ("tien su benh", "lich su benh", "past medical history", "pmh")),
    "present_illness": ("2", ("tien su benh hien tai", "benh su hien tai", "lich su benh hien tai", "benh su", "history of present illness")),
    "hospital_evaluation": ("3", ("danh gia tai benh vien", "kham tai benh vien", "kham tai vien", "luc vao vien", "assessment")),
}
FALLBACK = {
    "pre_admission": ("benh ly man tinh", "cac benh ly man tinh", "tien su phau thuat", "thuoc truoc khi nhap vien", "thuoc dang dieu tri", "home medication"),
    "present_illness": ("ly do nhap vien", "ly do vao vien", "trieu chung hien tai", "cac trieu chung hien tai", "dien bien benh", "tinh trang luc vao vien", "tinh trang ngay truoc khi nhap vien"),
    "hospital_evaluation": (
        "ket qua xet nghiem", "ket qua phong thi nghiem", "can lam sang", "ket qua chan doan hinh anh", "chan doan hinh anh", "thu thuat da thuc hien",
        "thu thuat thuc hien", "cac phat hien chan doan khac", "cac ket qua chan doan khac", "chan doan", "dieu tri", "xu tri thuoc",
    ),
}
SECTION_ROLE = {"pre_admission": "medical_history", "present_illness": "present_illness", "hospital_evaluation": "hospital_evaluation"}
QUESTION = ("cau hoi", "cau hoi tu nguoi dung", "cau hoi cua nguoi dung", "question")
ANSWER = ("cau tra loi", "cau tra loi cua bac si", "bac si tra loi", "dap")
HISTORY = {"tien su ban than": "personal_history", "tien su gia dinh": "family_history", "tien su dich te": "epidemiology_history"}
EVENTS = ("cac su kien truoc khi nhap vien", "su kien truoc khi nhap vien", "cac dien bien truoc khi nhap vien", "dien bien truoc khi nhap vien")
SYMPTOMS = ("dac diem cua trieu chung", "dac diem trieu chung", "trieu chung khi nhap vien", "trieu chung hien tai", "cac trieu chung lien quan", "thoi diem khoi phat trieu chung", "vi tri")
LABS = ("can lam sang", "xet nghiem", "xn luc vao vien", "ket qua xet nghiem", "ket qua laboratory", "ket qua phong thi nghiem", "ket qua chan doan hinh anh", "chan doan hinh anh va tham do", "dien tam do", "men tim", "sieu am tim")
DIAGNOSES = ("chan doan", "cac chan doan")
TREATMENTS = ("dieu tri", "don thuoc", "thuoc dieu tri", "xu tri thuoc")
ARTICLE_CUES = ("la gi", "dau hieu", "trieu chung", "nguyen nhan", "bien chung", "co nguy hiem", "can lam gi", "phong ngua", "dieu tri", "chan doan")
ADVICE = ("du hien tai", "de theo doi tai nha", "ban nen", "em nen", "gia dinh hay")
CASE_NOUNS = ("ho so", "truong hop", "ca benh", "benh nhan")
ORDINALS = ("nhat", "hai", "ba", "tu", "nam", "sau", "bay", "tam", "chin", "muoi")
ADMINISTRATIVE = (
    "phieu ban giao", "cong hoa xa hoi chu nghia viet nam", "bao cao tong hop", "tom tat danh sach", "ngay xuat", "nguoi xuat", "ca truc tu", "nguoi ban giao",
    "nguoi nhan", "ma so ho so", "thoi diem tiep nhan", "noi dung chi tiet", "phan i", "phan ii", "phan iii",
)
KEPT_TWICE = ("question", "answer", "medical_article", "patient_case", "personal_history", "family_history", "epidemiology_history")


def heads(key: Column, markers) -> Column:
    """Whether a key is a marker or begins with one and a blank or colon."""
    return key.rlike(f"^(?:{'|'.join(markers)})(?:$|[ :])")


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, line) of every line; empty lines too. Null texts have none."""
    parts = F.split("text", "\n")
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x) + 1))
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.arrays_zip(parts.alias("line"), F.slice(starts, 1, F.size(parts)).alias("start"))).alias("line_no", "x"))
    return rows.select("doc_id", "line_no", F.col("x.start").alias("start"), (F.col("x.start") + F.length("x.line")).alias("end"), F.col("x.line").alias("line"))


def keyed(rows: DataFrame) -> DataFrame:
    """lines with the stripped line, where it starts, and its key."""
    bare = F.regexp_extract("line", r"^[\s:\-*]*(.*?)[\s:\-*]*$", 1)
    at = F.col("start") + F.length(F.regexp_extract("line", r"^[\s:\-*]*", 0))
    rows = rows.withColumn("bare", bare).withColumn("at", at)
    return rows.select("*", F.inline(F.array(F.struct(normalize_key(F.col("bare")).alias("key"))))).where("key <> ''")


def _major(key: Column) -> Column:
    number, title = F.regexp_extract(key, r"^(\d+)\.* (.*)$", 1), F.regexp_extract(key, r"^(\d+)\.* (.*)$", 2)
    return F.coalesce(*(F.when((number == n) & heads(title, markers), name) for name, (n, markers) in MAJOR.items()))


def _fallback(key: Column) -> Column:
    return F.when(F.length(key) <= 140, F.coalesce(*(F.when(heads(key, markers), name) for name, markers in FALLBACK.items())))


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, name, start, end): numbered headings if a document has two or more, else the others; what comes before is `document`.

    Documents without headings give one section, `document`.
    """
    hits = keyed(lines(documents)).select("doc_id", "at", _major(F.col("key")).alias("major"), _fallback(F.col("key")).alias("fallback")).where("major IS NOT NULL OR fallback IS NOT NULL")
    by_doc = W.partitionBy("doc_id")
    hits = hits.withColumn("n_major", F.count("major").over(by_doc)).select("doc_id", F.col("at").alias("start"), F.when(F.col("n_major") >= 2, F.col("major")).otherwise(F.when(F.col("major").isNull(), F.col("fallback"))).alias("name")).where("name IS NOT NULL")
    lengths = documents.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n"))
    marked = hits.unionByName(lengths.select("doc_id", F.lit(0).alias("start"), F.lit("document").alias("name")))
    first = marked.groupBy("doc_id", "start").agg(F.coalesce(F.max(F.when(F.col("name") != "document", F.col("name"))), F.lit("document")).alias("name"))
    ends = first.withColumn("next", F.lead("start").over(W.partitionBy("doc_id").orderBy("start"))).join(lengths, "doc_id")
    return ends.select("doc_id", "name", "start", F.coalesce("next", "n").alias("end")).where("start < end OR n = 0")


def with_role(rows: DataFrame) -> DataFrame:
    """lines with a key, and the structural role that a line begins, or null. Parts that several rules use are columns of their own."""
    raw, key, heading = F.col("line"), F.col("key"), F.col("_heading")
    short_title = (F.size(F.split(heading, " ")) <= 14) & ~F.rtrim(raw).rlike(r"\.$")
    like = (F.length(key) <= 140) & (raw.rlike(r"^\s*\d+(?:\.\d+)*[.)/]?\s+") | F.rtrim(raw).rlike("[:：]$") | ((F.size(F.split(key, " ")) <= 12) & ~F.rtrim(raw).rlike("[.?!]$")))
    parts = {
        "_low": F.lower(F.regexp_replace(raw, r"^[\s*\-]+", "")),
        "_heading": F.regexp_replace(key, r"^\d+(?:\.\d+)*[.)/]?\s*", ""),
        "_major": _major(key),
    }
    rows = rows.withColumns(parts).withColumn("_like", like)
    person = r"^(?:\d+(?:\.\d+)*[.)/]?\s*)?(?:benh nhan|bn)\s+(?:nam|nu)"
    patient = key.rlike(person + r"\s+\d+\s+tuoi\b") | (key.rlike(person + r"\b") & F.left(key, F.lit(180)).contains("vao vien"))
    article = (F.length(heading) <= 150) & heading.rlike("|".join(ARTICLE_CUES)) & ~raw.rlike(r"^\s*[-*•]") & (raw.rlike(r"^\s*\d+(?:\.\d+)*[.)]?\s+") | short_title)
    low, headed = F.col("_low"), F.col("_like")
    steps = [
        (low.rlike(r"^(?:hỏi|hoi|question)\s*[:：-]") | heads(key, QUESTION), "question"),
        (low.rlike(r"^(?:trả lời|tra loi|đáp|dap|answer)\s*[:：-]") | heads(key, ANSWER), "answer"),
        *((F.col("_major") == name, r) for name, r in SECTION_ROLE.items()),
        (patient, "patient_case"),
        *((heads(heading, (m,)), r) for m, r in HISTORY.items()),
        (heads(heading, EVENTS), "pre_admission_events"),
        (heads(heading, SYMPTOMS), "symptom_profile"),
        (headed & heads(heading, LABS), "lab_or_imaging"),
        (headed & heads(heading, DIAGNOSES), "diagnosis"),
        (headed & heads(heading, TREATMENTS), "treatment"),
        (article, "medical_article"),
    ]
    named = F.array(F.struct(reduce(lambda c, s: c.when(*s), steps[1:], F.when(*steps[0])).alias("role")))
    kept = [c for c in rows.columns if c not in ("_low", "_heading", "_major", "_like")]
    # inline keeps later filters on the role from being pushed down, where the whole expression would be repeated
    return rows.select(*kept, F.inline(named))


def role_hits(documents: DataFrame) -> DataFrame:
    """(doc_id, start, role) of the lines that begin a role. After a question, the first line of advice in a part that is
    neither question nor answer begins an answer again."""
    rows = with_role(keyed(lines(documents))).select("doc_id", F.col("at").alias("start"), "role", (heads(F.col("key"), ADVICE) | F.concat(F.lit(" "), "key", F.lit(" ")).rlike(" (?:em|ban) nen ")).alias("advice"))
    rows = rows.where("role IS NOT NULL OR advice")
    order = W.partitionBy("doc_id").orderBy("start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("asked", F.coalesce(F.max(F.col("role") == "question").over(before), F.lit(False))).withColumn("active", F.last("role", True).over(before)).withColumn("island", F.count("role").over(order))
    back = F.col("advice") & F.col("asked") & ~F.col("active").isin("question", "answer")
    rows = rows.withColumn("back", F.coalesce(back, F.lit(False)))
    earlier = W.partitionBy("doc_id", "island", "role").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    first = rows.withColumn("done", F.coalesce(F.max("back").over(earlier), F.lit(False)))
    return first.select("doc_id", "start", F.when(F.col("back") & ~F.col("done"), "answer").otherwise(F.col("role")).alias("role")).where("role IS NOT NULL")


def role_blocks(hits: DataFrame, lengths: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(doc_id, role, start, end): hits that repeat the role before them are dropped, but for roles that may repeat. within: columns
    in whose parts of a document alone roles count as repeated; they are kept."""
    within, order = within or [], W.partitionBy("doc_id").orderBy("start")
    kept = hits.withColumn("before", F.lag("role").over(W.partitionBy("doc_id", *within).orderBy("start"))).where(F.col("before").isNull() | (F.col("before") != F.col("role")) | F.col("role").isin(*KEPT_TWICE))
    return kept.withColumn("next", F.lead("start").over(order)).join(lengths, "doc_id").select("doc_id", "role", "start", F.coalesce("next", "n").alias("end"), *within)


def structural_blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, role, start, end, case_no): section headings, role lines and the beginnings of cases as blocks; at one place the role
    line counts, and a case begins with the role of its section. A block that is nothing but a heading becomes part of the one
    after it in its case, in pairs from the first of a run of such blocks. Cases are numbered from 1."""
    starts = case_starts(documents)
    named = sections(documents).select("doc_id", "start", "name").unionByName(starts.select("doc_id", "start", F.lit(None).cast("string").alias("name")))
    named = named.withColumn("name", F.last("name", True).over(W.partitionBy("doc_id").orderBy("start", F.col("name").isNull())))
    from_sections = named.select("doc_id", "start", reduce(lambda c, kv: F.when(F.col("name") == kv[0], kv[1]).otherwise(c), SECTION_ROLE.items(), F.lit("document")).alias("role"), F.lit(0).alias("rank"))
    hits = from_sections.unionByName(role_hits(documents).withColumn("rank", F.lit(1))).groupBy("doc_id", "start").agg(F.max_by("role", "rank").alias("role"))
    lengths = documents.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n"))
    begins = starts.where("start > 0").select("doc_id", "start", F.lit(1).alias("_begins")).distinct()
    case_no = (F.count("_begins").over(W.partitionBy("doc_id").orderBy("start")) + 1).cast("int")
    hits = hits.join(begins, ["doc_id", "start"], "left").withColumn("case_no", case_no).drop("_begins")
    per_doc = role_blocks(hits, lengths, ["case_no"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "role", "case_no")).alias("bs"))
    placed = documents.select("doc_id", "text").join(per_doc, "doc_id").select("doc_id", "text", F.inline("bs"))
    value = F.regexp_replace(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), r"^\s+|\s+$", "")
    key = F.regexp_replace(F.regexp_replace(normalize_key(F.regexp_replace(value, r"^[*\- ]+|[*\- ]+$", "")), r"^\d+(?:\.\d+)*[.)/]?\s*", ""), r":+$", "")
    titles = [*(m for _, ms in MAJOR.values() for m in ms), *HISTORY, *LABS, *DIAGNOSES, *TREATMENTS, *SYMPTOMS, *EVENTS]
    bare = ~F.col("role").isin("question", "answer", "patient_case") & (F.length(value) <= 160) & ~value.contains("\n") & F.trim(key).isin(titles)
    rows = placed.select("doc_id", "start", "end", "role", "case_no", bare.alias("bare"))
    order = W.partitionBy("doc_id", "case_no").orderBy("start")
    rows = rows.withColumn("island", F.row_number().over(order) - F.row_number().over(W.partitionBy("doc_id", "case_no", "bare").orderBy("start"))).withColumn("next_end", F.lead("end").over(order)).withColumn("next_role", F.lead("role").over(order))
    odd = F.row_number().over(W.partitionBy("doc_id", "case_no", "bare", "island").orderBy("start")) % 2 == 1
    rows = rows.withColumn("joins", F.col("bare") & odd & F.col("next_end").isNotNull())
    rows = rows.withColumn("absorbed", F.coalesce(F.lag("joins").over(order), F.lit(False)))
    return rows.where("NOT absorbed").select("doc_id", F.when(F.col("joins"), F.col("next_role")).otherwise(F.col("role")).alias("role"), "start", F.when(F.col("joins"), F.col("next_end")).otherwise(F.col("end")).alias("end"), "case_no")


def case_starts(documents: DataFrame) -> DataFrame:
    """(doc_id, start) of the lines at which another case begins; a boundary after nothing but administrative lines is none."""
    rows = lines(documents).select("doc_id", "line_no", (F.col("start") + F.length(F.regexp_extract("line", r"^\s*", 0))).alias("start"), F.trim("line").alias("line")).withColumn("key", normalize_key(F.col("line"))).where("key <> ''")
    noun = "|".join(CASE_NOUNS)
    boundary = (F.length("key") <= 190) & (F.col("key").startswith("ma so ho so") | (F.col("line").rlike(r"^\d+\.\d+\.?\s+") & F.col("key").rlike(noun)) | F.col("key").rlike(f"(?:{noun}) thu (?:{'|'.join(ORDINALS)})"))
    substance = ~boundary & ~F.col("key").rlike(f"^(?:{'|'.join(ADMINISTRATIVE)})") & F.col("key").rlike(r"[^._\- ]")
    order = W.partitionBy("doc_id").orderBy("line_no")
    counted = rows.withColumn("boundary", boundary).withColumn("said", F.count_if(substance).over(order)).where("boundary")
    return counted.withColumn("before", F.lag("said").over(order)).where("before IS NULL OR said > before").select("doc_id", "start")


def section_at(points: DataFrame, documents: DataFrame) -> DataFrame:
    """points (doc_id, at, ...) with the name of the section they lie in, `document` where none; a range join within documents."""
    p, s = points.alias("p"), sections(documents).alias("s")
    inside = (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("s.start") <= F.col("p.at")) & (F.col("p.at") < F.col("s.end"))
    return p.join(s, inside, "left").select("p.*", F.coalesce("s.name", F.lit("document")).alias("section"))


def case_bounds(documents: DataFrame) -> DataFrame:
    """(doc_id, case_no, start, end) of the cases of a document, numbered from 1; a document without boundaries is one case, and
    what comes before the first boundary is a case too."""
    lengths = documents.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n"))
    starts = case_starts(documents).select("doc_id", "start").unionByName(lengths.select("doc_id", F.lit(0).alias("start"))).distinct()
    order = W.partitionBy("doc_id").orderBy("start")
    return starts.withColumn("next", F.lead("start").over(order)).withColumn("case_no", F.row_number().over(order)).join(lengths, "doc_id").select("doc_id", "case_no", "start", F.coalesce("next", "n").alias("end"))


def with_parts(spans: DataFrame, documents: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """spans (doc_id, start, ...) with the role, section and case_start of where they begin; 0 before the first case. Blocks are
    structural_blocks, if they are at hand. Parts are gathered per document, so that spans are never multiplied."""
    blocks = blocks if blocks is not None else structural_blocks(documents)
    gather = lambda parts, into, *cols: parts.groupBy("doc_id").agg(F.collect_set(F.struct(*cols)).alias(into))
    out = spans.join(gather(blocks.select("doc_id", "start", "end", "role"), "_blocks", "start", "end", "role"), "doc_id", "left").join(gather(sections(documents), "_sections", "start", "end", "name"), "doc_id", "left").join(gather(case_starts(documents), "_cases", "start"), "doc_id", "left")
    around = lambda parts: F.try_element_at(F.filter(parts, lambda x: (x["start"] <= F.col("start")) & (F.col("start") < x["end"])), F.lit(1))
    first = F.array_max(F.filter("_cases", lambda x: x["start"] <= F.col("start")))["start"]
    out = out.withColumn("role", F.coalesce(around("_blocks")["role"], F.lit("document"))).withColumn("section", F.coalesce(around("_sections")["name"], F.lit("document"))).withColumn("case_start", F.coalesce(first, F.lit(0)))
    return out.drop("_blocks", "_sections", "_cases")


def repeated_runs(documents: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, line_no, word_no, word, n) of runs of one word, in one line, of at least so many words."""
    rows = lines(documents).where(F.length("line") >= 2 * least - 1)
    words = rows.select("doc_id", "line_no", F.posexplode(F.transform(F.regexp_extract_all("line", F.lit(r"\p{L}+"), F.lit(0)), normalize_key)).alias("word_no", "word"))
    order = W.partitionBy("doc_id", "line_no").orderBy("word_no")
    same = W.partitionBy("doc_id", "line_no", "word").orderBy("word_no")
    islands = words.withColumn("island", F.row_number().over(order) - F.row_number().over(same))
    return islands.groupBy("doc_id", "line_no", "word", "island").agg(F.min("word_no").alias("word_no"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def extraction_load(text: Column) -> Column:
    """How much there is to extract from a text: clause cues and further lines, or its length if that is more; at least 1."""
    key = normalize_key(text)
    cues = F.regexp_count(key, F.lit(r"[,;:\n]|\b(?:va|hoac|khong|phu nhan)\b"))
    more_lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")) - 1
    return F.greatest(F.lit(1), cues + F.greatest(F.lit(0), more_lines), F.floor(F.length(key) / 220).cast("int"))


def neighbours(chunks: DataFrame, chars: int = 240) -> DataFrame:
    """chunks with the end of the chunk before and the beginning of the one after, where their scope is the same."""
    order = W.partitionBy("doc_id").orderBy("start_pos", "chunk_id")
    near = lambda f, cut: F.coalesce(F.when(f("context_scope").over(order) == F.col("context_scope"), cut(f("text").over(order))), F.lit(""))
    return chunks.select("doc_id", "chunk_id", near(F.lag, lambda t: F.right(t, F.lit(chars))).alias("before"), near(F.lead, lambda t: F.left(t, F.lit(chars))).alias("after"))


def needs_patient(structure_role: Column, text: Column, cues: list[str]) -> Column:
    """Whether a chunk is left out: an article or plain document without a cue that it is about a patient."""
    return structure_role.isin("medical_article", "document") & ~normalize_key(text).rlike("|".join(cues))
