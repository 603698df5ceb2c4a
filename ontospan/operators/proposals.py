"""Rule proposals of spans: lexicon phrases, drugs, prescription lines, lab values, conditions after a cue.

Lexicon terms are found by an automaton, patterns line by line in the JVM. Their offsets come from the lengths of the text before them, as positions
reported by the regular expression functions count UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG, SYMPTOM, TEST_NAME, TEST_RESULT
from ontospan.functions.rx import AHEAD, extended_end
from ontospan.functions.text import normalize_key
from ontospan.operators.notes import lines

BLOCK_TERMS = 500_000  # of the lexicon in a task's memory at a time
# Scores by type, lab names, units and results, cues.
SCORES = {DIAGNOSIS: 0.95, SYMPTOM: 0.80, TEST_NAME: 0.70, DRUG: 0.98, TEST_RESULT: 0.92}
LAB_NAMES = "bc ha n wbc twbc rbc hgb hct plt neut neut% lyph lyph% lymph lymph% mono mono% eos eos% baso baso% ast alt ap alp tbili dbili crp creatinine glucose ure bun hbsag spo2 na k cl ca".split()
LAB_WORDS = (
    "bach cau", "hong cau", "tieu cau", "hemoglobin", "hematocrit", "bilirubin", "phosphatase", "aspartate aminotransferase", "alanine aminotransferase", "creatinine", "creatinin",
    "glucose", "protein", "albumin", "men gan", "anti hbe", "anti hbc", "prothrombin", "de ritis", "huyet ap", "nhiet do", "mach", "nhip tim", "nhip tho", "do bao hoa oxy",
)
LAB_UNIT = "mg/dL|g/L|g/dL|mmol/L|mmol|micromol/L|umol/L|IU/L|U/L|mEq/L|ng/mL|ng/L|pg/mL|x10\\^?\\d*/L|G/L|T/L|ck/p|lần/phút|lan/phut|mmHg|°C|%"
LAB_RESULT = rf"(?:\d{{2,3}}\s*/\s*\d{{2,3}}(?:\s*mmHg)?|[<>]?\s*\d+(?:[,.]\d+)?(?:\s*(?:{LAB_UNIT}))?|\(\s*[+-]\s*\))"
LAB_WORDED = r"(?:chưa phát hiện bất thường(?: trên phim chụp)?|không phát hiện bất thường(?: trên phim chụp)?|đều tăng|bình thường|bất thường|âm tính|dương tính)"
LAB_PAIR = rf"(?i)([^;:=.]{{1,120}}?)(\s*(?::|=|(?<![\p{{L}}\p{{N}}])là(?![\p{{L}}\p{{N}}]))\s*)({LAB_RESULT})"
LAB_RATIO = rf"(?i)([A-Za-z]{{2,10}}\s*/\s*[A-Za-z]{{2,10}})(\s*[<>=]\s*)(\d+(?:[,.]\d+)?(?:\s*(?:{LAB_UNIT}))?)"
_NAMES = "|".join(sorted((n for n in [*LAB_NAMES, "anti hbe", "anti hbc igg", "anti hbc igm"]), key=lambda n: (-len(n), n)))
LAB_INLINE = rf"(?i)(?<![\p{{L}}\p{{N}}_])({_NAMES})((?![\p{{L}}\p{{N}}_])\s+)({LAB_RESULT})"
LAB_QUALITY = rf"(?i)(?<![\p{{L}}\p{{N}}_])({_NAMES})((?![\p{{L}}\p{{N}}_])[^.;:]{{0,45}}?\s+)({LAB_WORDED})"
GLUED = r"(?i)(chụp\s*ct)()(chưa\s+phát\s+hiện\s+bất\s+thường(?:\s+trên\s+phim\s+chụp)?)"
_COUNT = "(?:viên|vien|ống|ong|lọ|lo|gói|goi|vỉ|vi)"
_WORD, _MORE = r"[A-Za-zÀ-ỹ][\p{L}\p{N}_.+/-]*", r"[A-Za-zÀ-ỹ0-9][\p{L}\p{N}_.+/-]*"
_LEAD = r"(?i)^([ \t*•-]*)"
ORDER = rf"{_LEAD}({_WORD}(?:\s+{_WORD}){{0,2}}\s+\d+(?:[,.]\d+)?\s*(?:mcg|mg|g|iu|%)(?:\s*/\s*ml)?(?:\s*x\s*\d+\s*{_COUNT})?)()"
ORDER_COUNT = rf"{_LEAD}({_WORD}(?:\s+{_MORE}){{0,2}}\s+x\s*\d+\s*{_COUNT})()"
ORDER_CUES = ("thuoc", "dieu tri", "truyen", "tiem", "uong", "pha vao", "vien", "ong", "sang", "chieu")
CONDITION = r"(?i)((?:chẩn\s*đoán|chan\s*doan|diagnosis|dx)\s*(?::|mắc\s+bệnh|mac\s+benh|mắc|mac|là|la)\s*)(\s*)([^.;\n]+)"
NO_CONDITION = ("hinh anh", "chup x quang", "sieu am", "ct ", "mri ", "dien tam do", "ecg", "/ tham do", "va dieu tri")
NO_CONDITION_WORDS = ("khac", "tham do", "va dieu tri", "hinh anh")
NARRATIVE = ("benh nhan", "khi duoc chuyen", "khong con cam giac", "vao khoa dieu tri")
RESULT_CUES = (
    "ket qua", "xet nghiem", "chan doan hinh anh", "cho thay", "ghi nhan", "dien tam do", "ecg", "holter", "sieu am", "x quang", "ct ", "mri", "sinh thiet", "choc hut", "choc do", "ha",
    "huyet ap", "nhiet do", "mach", "nhip tim", "nhip tho", "spo2", "alt", "ast", "got", "gpt", "ggt",
)
ALWAYS_RESULT = "nhip xoang"
KNOWN_VALUE = r"(?i)^((?:\s*\([^)]+\))?\s*(?:là|:|=)\s*)([<>]?\s*\d+(?:[,.]\d+)?(?:\s*(?:mg/dL|g/L|mmol/L|mmol|IU/L|U/L|%))?)"


def found(line: Column, pattern: str) -> Column:
    """Array of struct(start, a, b, c) of the matches of a pattern whose three groups make up the whole match."""
    pieces = F.split(F.regexp_replace(line, pattern, "\u0001$1\u0002$2\u0002$3\u0003"), "\u0001")
    bare = lambda x: F.translate(x, "\u0002\u0003", "")
    part = lambda x, i: F.substring_index(F.substring_index(F.substring_index(x, "\u0003", 1), "\u0002", i), "\u0002", -1)
    start = lambda all_, i: F.length(bare(F.array_join(F.slice(all_, 1, i), "")))
    # the outer transform binds the pieces to a variable, so that they are worked out once and not for every match
    bound = F.transform(F.array(pieces), lambda all_: F.transform(all_, lambda x, i: F.struct(start(all_, i).alias("start"), part(x, 1).alias("a"), part(x, 2).alias("b"), part(x, 3).alias("c"))))
    return F.filter(F.flatten(bound), lambda m, i: i > 0)


def in_lines(documents: DataFrame, pattern: str, needs: str | None = None) -> DataFrame:
    """(doc_id, line_no, line, start, line_start, a, b, c) of all matches in all lines; needs: a cheaper pattern that any line with a
    match has a match of."""
    rows = lines(documents).where(F.col("line").rlike(needs) if needs else F.length("line") > 0).select("doc_id", "line_no", "line", F.col("start").alias("line_start"), F.explode(found(F.col("line"), pattern)).alias("m"))
    return rows.select("doc_id", "line_no", "line", "line_start", (F.col("line_start") + F.col("m.start")).alias("start"), "m.a", "m.b", "m.c")


def _automaton(terms: list[tuple[str, str]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, kind in terms:
        out.get(term, None) is None and out.add_word(term, (term, []))
        out.get(term)[1].append(kind)
    out.make_automaton()
    return out


def _lowered(text: str) -> str:
    """Lower case in as many characters: those that become several stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _occurrences(text: str, terms: ahocorasick.Automaton) -> Iterator[tuple[int, int, str, str]]:
    low = _lowered(text)
    word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    for last, (term, kinds) in terms.iter(low):
        first = last + 1 - len(term)
        if not word(first - 1) and not word(last + 1):
            for kind in kinds:
                yield first, last + 1, kind, term


def lexicon_spans(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, start, end, type, score, term): every occurrence of every term, in any letter case, as whole words.

    One pass of an Aho-Corasick automaton over each text, in Arrow batches: the work grows with the text and the occurrences,
    not with the lexicon. The lexicon goes to the tasks in blocks of BLOCK_TERMS; each block is a pass over the texts.
    Null terms, terms without a visible character and null texts give nothing; a term listed under two types gives both.
    """
    terms = lexicon.where(F.trim("term") != "").select(F.lower("term").alias("term"), F.col("concept_type").alias("type")).distinct()
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start int, end int, type string, term string"
    columns = [x.split()[0] for x in schema.split(", ")]

    def searching(block: list[tuple[str, str]]):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _automaton(block)
            for batch in batches:
                yield pd.DataFrame([(d, *x) for d, t in zip(batch.doc_id, batch.text) for x in _occurrences(t, known)], columns=columns)

        return each

    blocks: list[list[tuple[str, str]]] = [[]]
    for r in terms.toLocalIterator():
        if len(blocks[-1]) == BLOCK_TERMS:
            blocks.append([])
        blocks[-1].append((r.term, r.type))
    found = [rows.mapInPandas(searching(b), schema) for b in blocks if b] or [rows.sparkSession.createDataFrame([], schema)]
    score = reduce(lambda c, kv: F.when(F.col("type") == kv[0], kv[1]).otherwise(c), SCORES.items(), F.lit(0.5))
    return reduce(DataFrame.unionByName, found).select("doc_id", "start", "end", "type", score.alias("score"), "term")


def drug_spans(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lexicon drugs with the dose, route and form that follow them."""
    spans = lexicon_spans(documents, lexicon.where(F.col("concept_type") == DRUG)).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "term")).alias("xs"))
    seen = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring("text", x["end"] + 1, F.lit(AHEAD)).alias("after"))
    rows = documents.select("doc_id", "text").join(spans, "doc_id").select("doc_id", F.inline(F.transform("xs", seen)))
    return rows.select("doc_id", "start", (F.col("end") + extended_end(F.col("after"), F.lit(0))).alias("end"), F.lit(DRUG).alias("type"), F.lit(SCORES[DRUG]).alias("score"))


def _labs(documents: DataFrame, pattern: str, score: float) -> DataFrame:
    rows = in_lines(documents, pattern, rf"(?i)(?::|=|là)\s*{LAB_RESULT}" if pattern == LAB_PAIR else None)
    name = F.regexp_replace(F.regexp_replace("a", r"^[\s\-*•]+", ""), r"[\s.,;:]+$", "")
    lead = F.length("a") - F.length(F.regexp_replace("a", r"^[\s\-*•]+", ""))
    result = F.regexp_replace("c", r"^\s+|[\s.,;:]+$", "")
    result_start = F.col("start") + F.length("a") + F.length("b") + F.length(F.regexp_extract("c", r"^\s*", 0))
    return rows.select("doc_id", "line_no", "line", name.alias("name"), (F.col("start") + lead).alias("name_start"), result.alias("result"), result_start.alias("result_start"), F.lit(score).alias("score"))


def _lab_name(name: Column) -> Column:
    key = normalize_key(name)
    first = F.regexp_replace(F.substring_index(key, " ", 1), "^:+|:+$", "")
    return (key != "") & (first.isin(LAB_NAMES) | F.regexp_replace(first, "%+$", "").isin(LAB_NAMES) | key.rlike("|".join(LAB_WORDS)) | key.rlike(r"^[a-z]{2,8}%?(?:\s*\([^)]+\))?$"))


def lab_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, name, name_start, result, result_start, score) of `name: value` pairs with a plausible name."""
    return _labs(documents, LAB_PAIR, 0.99).where(_lab_name(F.col("name")) & (F.col("result") != ""))


def lab_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, start, end, type, score) of the names and results of all lab patterns, each place and type once."""
    parts = [lab_pairs(documents), *(_labs(documents, p, s) for p, s in ((LAB_INLINE, 0.99), (LAB_QUALITY, 0.99), (GLUED, 0.995)))]
    pairs = reduce(DataFrame.unionByName, parts)
    two = F.explode(F.array(F.struct(F.col("name_start").alias("start"), (F.col("name_start") + F.length("name")).alias("end"), F.lit(TEST_NAME).alias("type")), F.struct(F.col("result_start").alias("start"), (F.col("result_start") + F.length("result")).alias("end"), F.lit(TEST_RESULT).alias("type"))))
    spans = pairs.select("doc_id", two.alias("x"), "score").select("doc_id", "x.*", "score")
    ratios = in_lines(documents, LAB_RATIO).select("doc_id", "start", (F.col("start") + F.length("a") + F.length("b") + F.length("c")).alias("end"), F.lit(TEST_RESULT).alias("type"), F.lit(0.99).alias("score"))
    return spans.unionByName(ratios).where("start < end").groupBy("doc_id", "start", "end", "type").agg(F.max("score").alias("score"))


def in_window(spans: DataFrame, documents: DataFrame, before: int, after: int) -> DataFrame:
    """spans (doc_id, start, end, ...) with `context`, the key of the text around them; spans are gathered per document, so that
    texts are shuffled once and never copied per span."""
    columns = [c for c in spans.columns if c != "doc_id"]
    gathered = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("xs"))
    low = lambda x: F.greatest(F.lit(0), x["start"] - before)
    seen = lambda x: F.struct(*(x[c].alias(c) for c in columns), F.substring("text", low(x) + 1, x["end"] + after - low(x)).alias("context"))
    rows = documents.select("doc_id", "text").join(gathered, "doc_id").select("doc_id", F.inline(F.transform("xs", seen)))
    return rows.withColumn("context", normalize_key(F.col("context")))


def has_cue(key: Column, cues) -> Column:
    """Whether one of the cues stands anywhere in a key, also within words."""
    return reduce(lambda a, b: a | b, (F.contains(key, F.lit(c)) for c in cues))


def order_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, text) of drugs with a strength, a count or both at the beginning of a line, where a cue of a
    prescription stands near; concentrations per litre are none."""
    parts = []
    for pattern in (ORDER, ORDER_COUNT):
        rows = in_lines(documents, pattern)
        start = F.col("start") + F.length("a")
        rest = F.substring("line", start + F.length("b") - F.col("line_start") + 1, F.lit(6))
        parts.append(rows.where(~rest.rlike(r"(?i)^\s*/\s*(?:l|dl)\b")).select("doc_id", "line_no", start.alias("start"), (start + F.length("b")).alias("end"), F.regexp_replace("b", "[.,;:]+$", "").alias("text")))
    near = in_window(parts[0].unionByName(parts[1]), documents, 140, 100).where(has_cue(F.col("context"), ORDER_CUES))
    return near.select("doc_id", "line_no", "start", "text").distinct()


def cued_conditions(documents: DataFrame) -> DataFrame:
    """(doc_id, start, end, type, score, text) of what follows a cue like `diagnosis:` up to the end of the sentence; names of
    examinations, single vague words and long narratives are no conditions."""
    rows = in_lines(documents, CONDITION).select("doc_id", (F.col("start") + F.length("a") + F.length("b")).alias("start"), F.regexp_replace("c", r"[\s.,;:]+$", "").alias("text"))
    rows = rows.where(F.length("text") >= 4).withColumn("key", normalize_key(F.col("text")))
    n = F.size(F.filter(F.split("key", " "), lambda w: w != ""))
    no = ((n > 10) & has_cue(F.col("key"), NARRATIVE)) | F.col("key").isin(*NO_CONDITION_WORDS) | F.col("key").rlike(f"^(?:{'|'.join(NO_CONDITION)})")
    return rows.where(~no).select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), F.lit(DIAGNOSIS).alias("type"), F.lit(0.9).alias("score"), "text")


def contextual_results(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, start, end, type, score) of result phrases of the lexicon with a cue of an examination around them."""
    found_ = lexicon_spans(documents, lexicon.where(F.col("concept_type") == TEST_RESULT)).select("doc_id", "start", "end", "term")
    near = in_window(found_, documents, 140, 60)
    near = near.where(has_cue(F.col("context"), RESULT_CUES) | normalize_key(F.col("term")).startswith(ALWAYS_RESULT))
    return near.select("doc_id", "start", "end", F.lit(TEST_RESULT).alias("type"), F.lit(SCORES[TEST_RESULT]).alias("score"))


def known_values(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, start, end, type, score) of the tests of the lexicon (three characters or more) that a sign and a number follow,
    and of these numbers with their units; what stands in brackets between them is skipped."""
    tests = lexicon_spans(documents, lexicon.where((F.col("concept_type") == TEST_NAME) & (F.length("term") >= 3))).select("doc_id", "start", "end").distinct()
    gathered = tests.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("xs"))
    seen = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.regexp_extract(F.substring("text", x["end"] + 1, F.lit(1000)), KNOWN_VALUE, 1).alias("sign"), F.regexp_extract(F.substring("text", x["end"] + 1, F.lit(1000)), KNOWN_VALUE, 2).alias("value"))
    rows = documents.select("doc_id", "text").join(gathered, "doc_id").select("doc_id", F.inline(F.transform("xs", seen))).where("value <> ''")
    at = F.col("end") + F.length("sign")
    two = F.array(F.struct("start", "end", F.lit(TEST_NAME).alias("type")), F.struct(at.alias("start"), (at + F.length("value")).alias("end"), F.lit(TEST_RESULT).alias("type")))
    return rows.select("doc_id", F.inline(two)).select("doc_id", "start", "end", "type", F.lit(0.99).alias("score"))


def all_rules(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """All rule proposals of all documents: (doc_id, start, end, type, score)."""
    cols = ["doc_id", "start", "end", "type", "score"]
    orders = order_lines(documents).select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), F.lit(DRUG).alias("type"), F.lit(0.995).alias("score"))
    phrases = lexicon_spans(documents, lexicon.where(~F.col("concept_type").isin(DRUG, TEST_RESULT)))
    parts = [phrases, drug_spans(documents, lexicon), known_values(documents, lexicon), lab_spans(documents), contextual_results(documents, lexicon), orders, cued_conditions(documents)]
    return reduce(DataFrame.unionByName, (p.select(*cols) for p in parts)).groupBy("doc_id", "start", "end", "type").agg(F.max("score").alias("score"))
