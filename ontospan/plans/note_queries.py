"""Queries over notes: sections, roles, chunks, proposals, reconciliation of spans and context flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospan.config import ASSERTED, DIAGNOSIS, DRUG, SYMPTOM, TEST_NAME, TEST_RESULT
from ontospan.operators import assertions, notes, policy, proposals, proposer, spans
from ontospan.operators import chunking as chunker
from ontospan.plans import note_sql, role_sql, sql
from ontospan.plans.text_queries import LINES, NOTE, in_context, table


def section_spans(spark, sf):
    return notes.sections(table(spark, sf, "documents"))


def note_roles(spark, sf):
    return notes.role_hits(table(spark, sf, "documents"))


def structural_blocks(spark, sf):
    return notes.structural_blocks(table(spark, sf, "documents"))


def _reports(spark, sf) -> DataFrame:
    """Every note as a report of several cases, with the headings that begin cases and the lines of an office around them."""
    t = F.col("text")
    parts = [F.lit("PHIẾU BÀN GIAO\nNgười nhận: A\nMã số hồ sơ: 7\n1.1. Bệnh nhân B\n"), t, F.lit("\nTrường hợp thứ hai\n"), F.left(t, F.lit(40)), F.lit("\nCa bệnh thứ ba\nNgày xuất: 3/4\nHồ sơ thứ tư\nổn")]
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.concat(*parts).alias("text"))


def note_cases(spark, sf):
    return notes.case_starts(_reports(spark, sf))


def case_bounds(spark, sf):
    return notes.case_bounds(_reports(spark, sf))


def section_points(spark, sf):
    """The section in which each concept begins."""
    points = table(spark, sf, "concepts").where(F.size("char_position") == 2).select("doc_id", "concept_id", F.col("char_position")[0].alias("at")).distinct()
    return notes.section_at(points, table(spark, sf, "documents")).select("concept_id", "section")


def chunk_units(spark, sf):
    return chunker.units(_chunks(spark, sf)).drop("text")


def known_values(spark, sf):
    return proposals.known_values(table(spark, sf, "documents"), table(spark, sf, "lexicon")).drop("score").distinct()


def contextual_results(spark, sf):
    return proposals.contextual_results(table(spark, sf, "documents"), table(spark, sf, "lexicon")).select("doc_id", "start", "end")


def flags_in_parts(spark, sf):
    """Flags of concepts by the role and section of the chunk around them, and not reaching beyond its beginning as that of a case."""
    spans_ = _annotated(spark, sf, "concepts", "rule", 0.9)
    sections = F.when(F.col("c.structure_role").isin("medical_history", "treatment"), "pre_admission").when(F.col("c.structure_role") == "present_illness", "present_illness").otherwise("document")
    inside = (F.col("s.doc_id") == F.col("c.doc_id")) & (F.col("c.start_pos") <= F.col("s.start")) & (F.col("s.start") < F.col("c.end_pos"))
    placed = spans_.alias("s").join(_chunks(spark, sf).alias("c"), inside).select("s.doc_id", "s.start", "s.end", "s.type", F.col("c.structure_role").alias("role"), sections.alias("section"), F.col("c.start_pos").alias("case_start"))
    per_doc = placed.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "type", "role", "section", "case_start")).alias("xs"))
    joined = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text").join(per_doc, "doc_id")
    seen = lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "type", "role", "section", "case_start")), assertions.windows(F.col("text"), x["start"], x["end"], x["case_start"]).alias("window"))
    rows = joined.select("doc_id", F.inline(F.transform("xs", seen)))
    return assertions.flags_of(rows, F.col("role"), F.col("section")).select("doc_id", "start", "end", "type", "case_start", "negated", "family", "historical")


def ruled_drops(spark, sf):
    """Concepts that a small rule table calls noise, and why."""
    rules = [
        policy.Rule("short", (DRUG, SYMPTOM), {"mention": "^.{0,3}$"}),
        policy.Rule("denied", (SYMPTOM,), {"before": "khong( co)?$", "line": "^- "}),
        policy.Rule("said of a family", (), {"wide": "gia dinh"}, {"mention": "[0-9]", "prefix": "benh nhan"}),
        policy.Rule("goes on", (DIAGNOSIS,), {"after": "^(man|cap)"}),
    ]
    rows = in_context(spark, sf, f=lambda t, s, e: F.struct(*(c.alias(n) for n, c in policy.around(t, s, e).items())))
    return rows.select("concept_id", policy.first_result(rules, F.col("type"), {n: F.col(f"f.{n}") for n in ("mention", "before", "after", "prefix", "line", "wide")}).alias("rule")).where("rule IS NOT NULL")


def out_of_order(spark, sf):
    rows = table(spark, sf, "concepts_mirror").where(F.size("char_position") == 2).groupBy("doc_id", "idx").agg(F.min(F.struct(F.col("char_position")[0].alias("start"), F.col("char_position")[1].alias("end"), F.col("concept_type").alias("type"))).alias("x"))
    swapped = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, -F.col("idx")).otherwise(F.col("idx")).alias("idx"), "x.*")  # every third document backwards
    return policy.out_of_order(swapped)


def rejection_counts(spark, sf):
    """What became of the mentions of the deterministic proposer."""
    return proposer.rejections(lexicon_proposals(spark, sf))


def word_repeats(spark, sf):
    return notes.repeated_runs(table(spark, sf, "documents"), 2)


def extraction_loads(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", notes.extraction_load(F.col("text")).alias("load"))


def _chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "chunks").distinct()


def role_blocks(spark, sf):
    hits = _chunks(spark, sf).select("doc_id", F.col("start_pos").alias("start"), F.col("structure_role").alias("role"))
    lengths = _chunks(spark, sf).groupBy("doc_id").agg(F.max("end_pos").alias("n"))
    return notes.role_blocks(hits, lengths)


def neighbour_context(spark, sf):
    return notes.neighbours(_chunks(spark, sf))


def packed_chunks(spark, sf):
    return chunker.split_chunks(table(spark, sf, "documents")).drop("text")


def lexicon_spans(spark, sf):
    return proposals.lexicon_spans(table(spark, sf, "documents"), table(spark, sf, "lexicon")).select("doc_id", "start", "end", "type")


def lexicon_resolved(spark, sf):
    return spans.resolve_overlaps(proposals.lexicon_spans(table(spark, sf, "documents"), table(spark, sf, "lexicon"))).select("doc_id", "start", "end", "type")


def type_counts(spark, sf):
    """The flagship: which types of lexicon phrases occur in the documents after overlap resolution, and how often."""
    return lexicon_resolved(spark, sf).groupBy("type").agg(F.count("*").alias("n_spans"), F.count_distinct("doc_id").alias("n_documents"))


def lab_values(spark, sf):
    return proposals.lab_pairs(table(spark, sf, "documents")).select("doc_id", "name_start", "name", "result_start", "result")


def order_lines(spark, sf):
    return proposals.order_lines(table(spark, sf, "documents"))


def cued_conditions(spark, sf):
    """Of sentences made of concepts, one after each cue."""
    made = table(spark, sf, "concepts").where("text IS NOT NULL").select("concept_id", "text").distinct().groupBy("concept_id").agg(F.min("text").alias("text"))
    parts = [F.lit("Khám xong. Chẩn đoán: "), F.col("text"), F.lit(". Hẹn lại\nDx là "), F.col("text"), F.lit("; hết\nchan doan mac benh hình ảnh "), F.col("text"), F.lit("\nDiagnosis: khác.")]
    return proposals.cued_conditions(made.select(F.col("concept_id").alias("doc_id"), F.concat(*parts).alias("text"))).select("doc_id", "start", "text")


def drug_spans(spark, sf):
    return proposals.drug_spans(table(spark, sf, "documents"), table(spark, sf, "lexicon")).distinct()


def lexicon_proposals(spark, sf):
    """What the deterministic proposer says about chunks."""
    terms = proposer.lexicon_terms(table(spark, sf, "lexicon"))
    return proposer.proposed(_chunks(spark, sf), proposer.lexicon_proposer(terms)).select("doc_id", "chunk_id", "start", "end", "type", "reason")


def _annotated(spark, sf, name, source, score) -> DataFrame:
    rows = table(spark, sf, name).where(F.size("char_position") == 2)
    return rows.select("doc_id", F.col("char_position")[0].alias("start"), F.col("char_position")[1].alias("end"), F.col("concept_type").alias("type"), F.lit(score).alias("score"), F.lit(source).alias("source")).distinct()


def merged_spans(spark, sf):
    both = _annotated(spark, sf, "concepts", "rule", 0.9).unionByName(_annotated(spark, sf, "concepts_mirror", "llm", 0.75))
    return spans.merge_proposals(both).select("doc_id", "start", "end", "type", "source")


def gated_spans(spark, sf):
    rules = _annotated(spark, sf, "concepts", "rule", 0.9)
    return spans.gate(rules, _chunks(spark, sf), _annotated(spark, sf, "concepts_mirror", "llm", 0.75), ["question", "answer", "medical_article", "lab_or_imaging"]).select("doc_id", "start", "end", "type", "structure_role")


def span_relations(spark, sf):
    return spans.relations(_annotated(spark, sf, "concepts", "rule", 0.9))


def unnested_spans(spark, sf):
    return spans.drop_nested(_annotated(spark, sf, "concepts", "rule", 0.9), inner=SYMPTOM, outer=DIAGNOSIS).select("doc_id", "start", "end", "type")


def best_copies(spark, sf):
    rows = table(spark, sf, "concepts_mirror").where(F.size("char_position") == 2).select("doc_id", F.col("char_position")[0].alias("start"), F.col("char_position")[1].alias("end"), F.col("concept_type").alias("type"), F.col("concept_id").alias("row_id"), F.array_join("candidates", "|").alias("joined"), "candidates")
    return spans.dedupe_best(rows.drop("joined")).select("doc_id", "start", "end", "type", "row_id")


def context_flags(spark, sf):
    return assertions.flags_of(in_context(spark, sf, window=assertions.windows)).select("concept_id", "negated", "family", "historical")


def concept_problems(spark, sf):
    """Of concepts that have been damaged, each in one way, by their id."""
    rows = in_context(spark, sf, there=lambda t, s, e: F.substring(t, s + 1, e - s), n_chars=lambda t, s, e: F.length(t)).join(table(spark, sf, "concepts").select("concept_id", "text", "assertions", "candidates").distinct(), "concept_id")
    of = lambda k, damaged, c: F.when(F.col("concept_id") % 11 == k, damaged).otherwise(F.col(c))
    broken = {"text": of(0, F.lit(None), "text"), "type": of(1, F.lit("?"), "type"), "end": of(2, F.col("end") + 1_000_000, "end"), "start": of(3, F.lit(-1), "start"), "assertions": of(4, F.array(F.lit("isNegated")), "assertions"), "candidates": of(5, F.array(F.lit("X")), "candidates")}
    rows = rows.withColumns(broken).withColumn("text", of(6, F.concat("text", F.lit("!")), "text")).withColumn("assertions", of(7, F.array(F.lit("odd")), "assertions"))
    found = policy.problems(F.col("type"), F.col("text"), F.col("start"), F.col("end"), F.col("there"), F.col("n_chars"), F.col("assertions"), F.col("candidates"))
    return rows.select("concept_id", F.explode(found).alias("problem")).distinct()


def _heads(k: str, markers) -> str:
    return f"regexp_matches({k}, '^(?:{'|'.join(markers)})(?:$|[ :])')"


_major = "CASE " + " ".join(f"WHEN regexp_extract(key, '^([0-9]+)\\.* (.*)$', 1) = '{n}' AND {_heads(f'''regexp_extract(key, '^([0-9]+)[.]* (.*)$', 2)''', m)} THEN '{name}'" for name, (n, m) in notes.MAJOR.items()) + " END"
_fallback = "CASE WHEN length(key) > 140 THEN NULL " + " ".join(f"WHEN {_heads('key', m)} THEN '{name}'" for name, m in notes.FALLBACK.items()) + " END"
_BARE = "regexp_extract(line, '^[\\s:\\-*]*(.*?)[\\s:\\-*]*$', 1)"
_spans = lambda t, ver: f"(SELECT DISTINCT doc_id, char_position[1] AS s, char_position[2] AS e, concept_type AS type FROM {t} WHERE len(char_position) = 2)"
_A, _B = _spans("concepts", ""), _spans("concepts_mirror", "")
_RANK = "CASE type " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in spans.TYPE_RANK.items()) + " ELSE 5 END"
_CH = "(SELECT DISTINCT * FROM chunks)"
_fold = lambda order, cols: f"list_reduce(list_transform(list_sort(list(struct_pack({order}, {cols}))), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(acc, x) ELSE acc END)"
_LEX = f"(SELECT DISTINCT doc_id, s + i - 1 AS s, s + i - 1 + n AS e, type FROM (SELECT doc_id, s, line, i, regexp_extract(lower(line[i:]), '^[\\p{{L}}\\p{{N}}_]+') AS w FROM (SELECT doc_id, s, line, unnest(range(1, length(line) + 1)) AS i FROM {LINES}) WHERE regexp_matches(line[i], '[\\p{{L}}\\p{{N}}_]') AND (i = 1 OR NOT regexp_matches(line[i - 1], '[\\p{{L}}\\p{{N}}_]'))) JOIN (SELECT DISTINCT lower(term) AS t, concept_type AS type, length(term) AS n, regexp_extract(lower(term), '^[\\p{{L}}\\p{{N}}_]+') AS w FROM lexicon) USING (w) WHERE lower(line[i:i + n - 1]) = t AND NOT regexp_matches(line[i + n], '^[\\p{{L}}\\p{{N}}_]'))"
_RESOLVED = f"(SELECT doc_id, unnest({_fold(f'o1 := s - e, o2 := {_RANK}, o3 := -score, o4 := s, o5 := type', 's := s, e := e, type := type')}) AS x FROM (SELECT *, CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in proposals.SCORES.items()) + f" ELSE 0.5 END AS score FROM {_LEX}) GROUP BY doc_id)"
_K = sql.key
_cl = "regexp_extract(string_split(text[1:s], chr(10))[-1], '[^.;:]*$')"
_scope = f"regexp_extract(ctx, '^.*({assertions.NEGATION}.*)$', 1)"
_tail = lambda k, n: f"right({k}, {n})"
_fam = lambda k: f"regexp_matches({_tail(k, 180)}, '{assertions.FAMILY}')"
_m = lambda c, p: f"regexp_matches({c}, '{p}')"
_names = "|".join
QUERIES = {f.__name__: f for f in (section_spans, note_roles, structural_blocks, note_cases, word_repeats, extraction_loads, role_blocks, neighbour_context, packed_chunks, lexicon_spans, lexicon_resolved, type_counts, lab_values, order_lines, cued_conditions, drug_spans, lexicon_proposals, rejection_counts, case_bounds, section_points, chunk_units, known_values, contextual_results, flags_in_parts, ruled_drops, out_of_order, merged_spans, gated_spans, span_relations, unnested_spans, best_copies, context_flags, concept_problems)}
_SECTIONS = f"""WITH hits AS (SELECT doc_id, s + length(regexp_extract(line, '^[\\s:\\-*]*')) AS p, {_major} AS major, {_fallback} AS fallback FROM (SELECT *, {_K(_BARE)} AS key FROM {LINES}) WHERE key <> ''),
      kept AS (SELECT doc_id, p, CASE WHEN nm >= 2 THEN major WHEN major IS NULL THEN fallback END AS name FROM (SELECT *, count(major) OVER (PARTITION BY doc_id) AS nm FROM hits WHERE major IS NOT NULL OR fallback IS NOT NULL)),
      marks AS (SELECT doc_id, p, coalesce(max(name) FILTER (name <> 'document'), 'document') AS name FROM (SELECT doc_id, p, name FROM kept WHERE name IS NOT NULL UNION ALL SELECT doc_id, 0, 'document' FROM documents WHERE text IS NOT NULL) GROUP BY ALL)
      SELECT doc_id, name, p AS start, e AS "end" FROM (SELECT m.doc_id, name, p, coalesce(lead(p) OVER (PARTITION BY m.doc_id ORDER BY p), length(text)) AS e, length(text) AS n FROM marks m JOIN documents d USING (doc_id)) WHERE p < e OR n = 0"""
SQL = {
    "section_spans": _SECTIONS,
    "section_points": f"SELECT DISTINCT concept_id, coalesce(s.name, 'document') AS section FROM (SELECT DISTINCT concept_id, doc_id, char_position[1] AS p FROM concepts WHERE len(char_position) = 2) c LEFT JOIN ({_SECTIONS}) s ON s.doc_id = c.doc_id AND s.start <= c.p AND c.p < s.\"end\"",
    "extraction_loads": f"SELECT doc_id, greatest(1, len(regexp_extract_all(k, '[,;:\\n]|\\b(?:va|hoac|khong|phu nhan)\\b')) + greatest(0, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) - 1), length(k) // 220) AS load FROM (SELECT doc_id, text, {_K('text')} AS k FROM documents WHERE text IS NOT NULL)",
    "word_repeats": f"""WITH w AS (SELECT doc_id, line_no, i - 1 AS word_no, {_K('ws[i]')} AS word FROM (SELECT doc_id, line_no, regexp_extract_all(line, '\\p{{L}}+') AS ws FROM {LINES} WHERE length(line) >= 3), unnest(range(1, len(ws) + 1)) AS r(i)),
      g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY word_no) - row_number() OVER (PARTITION BY doc_id, line_no, word ORDER BY word_no) AS island FROM w)
      SELECT doc_id, line_no, word, min(word_no) AS word_no, count(*) AS n FROM g GROUP BY doc_id, line_no, word, island HAVING count(*) >= 2""",
    "role_blocks": f"""WITH h AS (SELECT doc_id, start_pos AS s, structure_role AS role, lag(structure_role) OVER (PARTITION BY doc_id ORDER BY start_pos) AS b FROM {_CH}), n AS (SELECT doc_id, max(end_pos) AS n FROM {_CH} GROUP BY 1)
      SELECT doc_id, role, s AS start, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), n) AS "end" FROM h JOIN n USING (doc_id) WHERE b IS NULL OR b <> role OR role IN ({', '.join(f"'{r}'" for r in notes.KEPT_TWICE)})""",
    "neighbour_context": f"SELECT doc_id, chunk_id, CASE WHEN lag(context_scope) OVER w = context_scope THEN right(lag(text) OVER w, 240) ELSE '' END AS before, CASE WHEN lead(context_scope) OVER w = context_scope THEN left(lead(text) OVER w, 240) ELSE '' END AS after FROM {_CH} WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos, chunk_id)",
    "lexicon_spans": f'SELECT doc_id, s AS start, e AS "end", type FROM {_LEX}',
    "lexicon_resolved": f'SELECT doc_id, x.s AS start, x.e AS "end", x.type AS type FROM {_RESOLVED}',
    "type_counts": f"SELECT x.type AS type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_documents FROM {_RESOLVED} GROUP BY 1",
    "merged_spans": f"""SELECT doc_id, x.s AS start, x.e AS "end", x.type AS type, x.source AS source FROM (SELECT doc_id, unnest({_fold(f"o1 := CASE source WHEN 'rule' THEN 0 ELSE 1 END, o2 := -score, o3 := CASE source WHEN 'rule' THEN s - e ELSE e - s END, o4 := {_RANK}, o5 := s, o6 := e, o7 := type", 's := s, e := e, type := type, source := source')}) AS x FROM (SELECT *, 'rule' AS source, 0.9 AS score FROM {_A} UNION ALL SELECT *, 'llm', 0.75 FROM {_B}) WHERE s < e GROUP BY doc_id)""",
    "gated_spans": f"""WITH r AS (SELECT a.*, arg_min(c.structure_role, (c.end_pos - c.start_pos, c.start_pos, c.structure_role)) FILTER (c.doc_id IS NOT NULL) AS role FROM {_A} a LEFT JOIN {_CH} c ON a.doc_id = c.doc_id AND c.start_pos <= a.s AND a.e <= c.end_pos GROUP BY ALL)
      SELECT r.doc_id, r.s AS start, r.e AS "end", r.type, role AS structure_role FROM r LEFT JOIN {_B} b USING (doc_id, s, e, type) WHERE NOT coalesce(role IN ('question', 'answer', 'medical_article', 'lab_or_imaging'), false) OR b.doc_id IS NOT NULL""",
    "span_relations": f"SELECT a.doc_id, a.s AS source_start, b.s AS target_start, CASE a.type WHEN '{DRUG}' THEN 'treats' ELSE 'has_result' END AS relation FROM {_A} a JOIN {_A} b ON a.doc_id = b.doc_id AND abs(a.s - b.s) <= 120 WHERE a.type = '{DRUG}' AND b.type IN ('{SYMPTOM}', '{DIAGNOSIS}') OR a.type = '{TEST_NAME}' AND b.type = '{TEST_RESULT}'",
    "unnested_spans": f"SELECT doc_id, s AS start, e AS \"end\", type FROM {_A} a WHERE NOT (type = '{SYMPTOM}' AND EXISTS (SELECT 1 FROM {_A} b WHERE b.doc_id = a.doc_id AND b.type = '{DIAGNOSIS}' AND b.s <= a.s AND a.e <= b.e AND a.e - a.s < b.e - b.s))",
    "best_copies": "SELECT doc_id, char_position[1] AS start, char_position[2] AS \"end\", concept_type AS type, arg_max(concept_id, (coalesce(len(candidates), 0), -concept_id)) AS row_id FROM concepts_mirror WHERE len(char_position) = 2 GROUP BY ALL",
    "context_flags": f"""WITH n AS (SELECT concept_id, type, type IN ({', '.join(f"'{t}'" for t in ASSERTED)}) AND length(string_split(text[1:s], chr(10))[-1]) + e - s + length(string_split(text[e + 1:], chr(10))[1]) < 300 AS ok, {_K(_cl)} AS clause, {_K("string_split(text[1:s], chr(10))[-1]")} AS line, {_K("text[s + 1:e]")} AS mention, {_K("right(text[1:s], 700)")} AS recent FROM {NOTE}),
      c AS (SELECT *, trim(clause || ' ' || mention) AS ctx, line || ' ' || clause AS local FROM n)
      SELECT concept_id, ok AND {_scope} <> '' AND NOT {_m(_scope, assertions.NOT_NEGATED)} AND NOT {_m(_scope, assertions.CONTRAST)} AS negated, ok AND ({_fam('line')} OR {_fam('recent')}) AS family,
        ok AND CASE WHEN type = '{DRUG}' THEN CASE WHEN {_m('local', assertions.CURRENT_DRUG)} OR {_m(_tail('recent', 180), assertions.CURRENT_DRUG)} THEN false WHEN {_m('local', assertions.PAST_DRUG)} THEN true ELSE {_m(_tail('recent', 450), assertions.PAST_PART)} END
          ELSE {_m('local', assertions.HISTORY)} OR (type = '{DIAGNOSIS}' AND {_m(_tail('recent', 450), assertions.PAST_PART)}) END AS historical FROM c""",
    **note_sql.SQL,
    **role_sql.SQL,
    "structural_blocks": role_sql.blocks(_SECTIONS),
}
