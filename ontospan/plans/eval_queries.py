"""Queries of evaluation and learning: concepts are the gold, the mirror's latest state is the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG
from ontospan.functions.text import normalize_key
from ontospan.operators import evaluate, learn, policy, terminology
from ontospan.plans import sql
from ontospan.plans.text_queries import table


def _gold(spark, sf) -> DataFrame:
    rows = table(spark, sf, "concepts").drop("received_at").distinct()
    return rows.select("concept_id", "doc_id", "idx", "text", F.col("concept_type").alias("type"), F.get("char_position", F.lit(0)).alias("start"), F.get("char_position", F.lit(1)).alias("end"), "assertions", "candidates")


def _predicted(spark, sf) -> DataFrame:
    """The latest state of each concept in the mirror, under the smallest row of equal times."""
    rows = table(spark, sf, "concepts_mirror").groupBy("concept_id").agg(F.max(F.struct("synced_at", "text", "doc_id", "idx", "concept_type", "char_position", "assertions", "candidates")).alias("x"))
    return rows.select("concept_id", "x.doc_id", "x.idx", "x.text", F.col("x.concept_type").alias("type"), F.get("x.char_position", F.lit(0)).alias("start"), F.get("x.char_position", F.lit(1)).alias("end"), "x.assertions", "x.candidates")


def bag_counts(spark, sf):
    return evaluate.bag_counts(_gold(spark, sf), _predicted(spark, sf), ["doc_id"], ["type", "start", "end"])


def type_quality(spark, sf):
    return evaluate.precision_recall(evaluate.bag_counts(_gold(spark, sf), _predicted(spark, sf), ["type"], ["doc_id", "start", "end"]))


def _paired(spark, sf) -> DataFrame:
    p = _predicted(spark, sf).select("concept_id", F.col("candidates").alias("predicted"))
    return _gold(spark, sf).where(F.col("type").isin(DIAGNOSIS, DRUG)).select("concept_id", "type", "text", F.col("candidates").alias("expected")).join(p, "concept_id")


def set_scores(spark, sf):
    return evaluate.set_scores(_paired(spark, sf), "expected", "predicted", ["type"])


def _mapped(spark, sf) -> DataFrame:
    """Coded concepts with expected and predicted codes, the codes that equality of keys finds, whether the terminology knows an
    expected one, and whether the context forbids a code (here: long names)."""
    kb, empty = table(spark, sf, "kb_records"), F.array().cast("array<string>")
    known = kb.select(F.col("concept_type").alias("type"), "code").distinct()
    hits = terminology.inverted_aliases(kb).select(F.col("concept_type").alias("type"), "alias_norm", F.col("codes").alias("hits"))
    files = table(spark, sf, "documents").select("doc_id", F.coalesce("case_id", F.lit("?")).alias("file"), F.coalesce("note_kind", F.lit("?")).alias("profile"))
    rows = _paired(spark, sf).withColumn("expected", F.coalesce("expected", empty)).withColumn("predicted", F.coalesce("predicted", empty)).withColumn("alias_norm", normalize_key(F.col("text")))
    in_kb = rows.select("concept_id", "type", F.explode("expected").alias("code")).join(known, ["type", "code"]).select("concept_id").distinct().withColumn("known", F.lit(True))
    rows = rows.join(in_kb, "concept_id", "left").join(hits, ["type", "alias_norm"], "left").join(table(spark, sf, "concepts").select("concept_id", "doc_id").distinct(), "concept_id").join(files, "doc_id")
    rows = rows.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("hits", F.coalesce("hits", empty)).withColumn("gated", F.length("alias_norm") > 30)
    return rows.withColumn("outcome", evaluate.mapping_outcome(F.col("expected"), F.col("predicted"), F.col("known"), F.col("hits"), F.col("gated")))


def mapping_outcomes(spark, sf):
    """Outcomes per type, and over all types (null)."""
    return _mapped(spark, sf).groupingSets([["type", "outcome"], ["outcome"]], "type", "outcome").agg(F.count("*").alias("n"))


def mapping_stats(spark, sf):
    return evaluate.mapping_stats(_mapped(spark, sf), ["type", "profile"])


def top_errors(spark, sf):
    return evaluate.top_errors(_mapped(spark, sf))


def worst_files(spark, sf):
    return evaluate.worst_files(_mapped(spark, sf))


def layered_report(spark, sf):
    return evaluate.layered_report(_gold(spark, sf), _predicted(spark, sf))


def error_rows(spark, sf):
    gold, predicted = _gold(spark, sf), _predicted(spark, sf)
    return evaluate.error_rows(gold, predicted, evaluate.greedy_match(evaluate.scored_pairs(gold, predicted)))


def gold_draft(spark, sf):
    return evaluate.gold_draft(_predicted(spark, sf))


def bad_positions(spark, sf):
    """Of concepts whose places have been damaged by their id."""
    p, k = F.col("char_position"), F.col("concept_id") % 7
    damaged = F.when(k == 0, F.reverse(p)).when(k == 1, F.slice(p, 1, 1)).when(k == 2, F.transform(p, lambda x: x - 1_000_000)).when(k == 3, F.array(p[0], p[0])).otherwise(p)
    return evaluate.bad_positions(table(spark, sf, "concepts").select("concept_id", damaged.alias("char_position")))


def empty_support(spark, sf):
    return learn.empty_support(_labelled(spark, sf).where("candidates IS NOT NULL"))


def dominant_codes(spark, sf):
    return learn.dominant_codes(_labelled(spark, sf).where("candidates IS NOT NULL")).withColumn("codes", F.array_join("codes", "|"))


def repaired_codes(spark, sf):
    """Empty candidates of concepts filled with the first code that equality of keys finds."""
    rows = table(spark, sf, "concepts").select("concept_id", F.col("concept_type").alias("type"), "text", "candidates").distinct()
    kb = terminology.alias_index(table(spark, sf, "kb_records")).where("rank = 0")
    asked = rows.select("type", "text").distinct().withColumn("alias_norm", normalize_key(F.col("text")))
    found = asked.join(kb.select(F.col("concept_type").alias("type"), "alias_norm", "code"), ["type", "alias_norm"])
    return policy.repaired(rows, found).select("concept_id", F.array_join("candidates", "|").alias("codes"))


def match_pairs(spark, sf):
    return evaluate.scored_pairs(_gold(spark, sf), _predicted(spark, sf)).withColumn("score", F.round("score", 6))


def greedy_matches(spark, sf):
    return evaluate.greedy_match(evaluate.scored_pairs(_gold(spark, sf), _predicted(spark, sf))).select("doc_id", "gold_index", "pred_index")


def document_scores(spark, sf):
    gold, predicted = _gold(spark, sf), _predicted(spark, sf)
    out = evaluate.document_scores(gold, predicted, evaluate.greedy_match(evaluate.scored_pairs(gold, predicted)))
    return out.select("doc_id", "matched", "missing", "extra", *(F.round(c, 4).alias(c) for c in ("text_score", "assertion_score", "candidate_numerator")), "candidate_denominator")


def corpus_score(spark, sf):
    gold, predicted = _gold(spark, sf), _predicted(spark, sf)
    return evaluate.corpus_score(evaluate.document_scores(gold, predicted, evaluate.greedy_match(evaluate.scored_pairs(gold, predicted))))


def _labelled(spark, sf) -> DataFrame:
    sources = table(spark, sf, "documents").select("doc_id", F.coalesce("case_id", F.lit("?")).alias("file"))
    return table(spark, sf, "concepts").drop("received_at").distinct().join(sources, "doc_id").select("concept_id", "doc_id", "text", "concept_type", "assertions", "candidates", "file")


def alias_statistics(spark, sf):
    return learn.alias_statistics(_labelled(spark, sf).where("candidates IS NOT NULL"))


def set_distribution(spark, sf):
    return learn.set_distribution(_labelled(spark, sf).where("candidates IS NOT NULL")).select("concept_type", "alias_norm", F.array_join("codes", "|").alias("codes"), "support")


def preferred_sets(spark, sf):
    out = learn.preferred_sets(learn.set_distribution(_labelled(spark, sf).where("candidates IS NOT NULL")))
    return out.select("concept_type", "alias_norm", F.array_join("codes", "|").alias("codes"), F.round("utility", 4).alias("utility"))


def learned_rules(spark, sf):
    p = _predicted(spark, sf).select("concept_id", F.col("candidates").alias("predicted"))
    items = _labelled(spark, sf).where("candidates IS NOT NULL").join(p, "concept_id").select("file", "concept_type", normalize_key(F.col("text")).alias("alias_norm"), F.lit("short_line").alias("profile"), "assertions", F.col("candidates").alias("expected"), "predicted")
    return learn.learned_rules(items).select("concept_type", "alias_norm", "flags", F.array_join("codes", "|").alias("codes"), "support", "file_support", F.round("gain", 4).alias("gain"))


def phrase_lexicon(spark, sf):
    return learn.phrase_lexicon(_labelled(spark, sf))


def majority_types(spark, sf):
    return learn.majority_types(table(spark, sf, "concept_snapshots").where("text IS NOT NULL"))


def supplemental_codes(spark, sf):
    """Codes of labels that the terminology lacks; a seventh of the labels is given a code of its own before."""
    codes = F.when(F.col("concept_id") % 7 == 0, F.transform("candidates", lambda c: F.concat(c, F.lit("+")))).otherwise(F.col("candidates"))
    return learn.supplemental(_labelled(spark, sf).withColumn("candidates", codes), table(spark, sf, "kb_records"))


def restored_codes(spark, sf):
    """Every snapshot's empty candidates restored from the snapshot before it."""
    rows = table(spark, sf, "concept_snapshots").select("snapshot_no", "concept_id", "doc_id", "text", "concept_type", "char_position", "candidates").distinct()
    older = rows.withColumn("snapshot_no", F.col("snapshot_no") + 1)
    out = learn.restored(rows.where("snapshot_no > 1"), older, ["snapshot_no"])
    return out.where("candidates IS NOT NULL").select("snapshot_no", "concept_id", "text", F.array_join("restored", "|").alias("codes")).distinct()


_K = sql.key
_G = "(SELECT DISTINCT concept_id, doc_id, idx, text, concept_type AS type, char_position[1] AS s, char_position[2] AS e, assertions, candidates FROM concepts)"
_P = "(SELECT concept_id, x.doc_id AS doc_id, x.idx AS idx, x.text AS text, x.concept_type AS type, x.char_position[1] AS s, x.char_position[2] AS e, x.assertions AS assertions, x.candidates AS candidates FROM (SELECT concept_id, arg_max(struct_pack(doc_id, idx, text, concept_type, char_position, assertions, candidates), (synced_at, text)) AS x FROM concepts_mirror GROUP BY 1))"
_PAIRED = f"(SELECT concept_id, g.type, coalesce(g.candidates, []) AS e, coalesce(p.candidates, []) AS p FROM {_G} g JOIN {_P} p USING (concept_id) WHERE g.type IN ('{DIAGNOSIS}', '{DRUG}'))"
_J = lambda a, b: f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
_L = "(SELECT c.*, coalesce(d.case_id, '?') AS file FROM (SELECT DISTINCT concept_id, doc_id, idx, text, concept_type, char_position, assertions, candidates FROM concepts) c JOIN documents d USING (doc_id))"
_SETS = f"(SELECT concept_type, {_K('text')} AS alias_norm, list_sort(list_distinct(candidates)) AS codes, count(*) AS support FROM {_L} WHERE candidates IS NOT NULL AND {_K('text')} <> '' GROUP BY ALL)"
_BAG = lambda g, i: f"(SELECT {g}, sum(least(x, y)) AS tp, sum(greatest(0, y - x)) AS fp, sum(greatest(0, x - y)) AS fn FROM (SELECT {g}, {i}, count(*) FILTER (k = 0) AS x, count(*) FILTER (k = 1) AS y FROM (SELECT doc_id, type, s, e, 0 AS k FROM {_G} UNION ALL SELECT doc_id, type, s, e, 1 FROM {_P}) GROUP BY ALL) GROUP BY {g})"
_W = lambda c: sql.tokens(_K(f"coalesce({c}, '')"))
_letters = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(CAST(40 + list_position(k, t) AS INT))), '')"
_LIKE = f"CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE greatest(0.0, 1 - levenshtein({_letters('a')}, {_letters('b')})::DOUBLE / len(a)) END"
_OVER = "greatest(0, least(ge, pe) - greatest(gs, ps))"
_MATCH = f"(SELECT doc_id, gold_index, pred_index, round(0.7::DOUBLE * CASE WHEN gs IS NULL OR ps IS NULL OR {_OVER} = 0 THEN 0.0::DOUBLE ELSE {_OVER}::DOUBLE / (greatest(ge, pe) - least(gs, ps)) END + 0.3::DOUBLE * ({_LIKE}), 9) AS score FROM (SELECT *, list_distinct(list_concat(a, b)) AS k FROM (SELECT g.doc_id, g.idx AS gold_index, p.idx AS pred_index, g.s AS gs, g.e AS ge, p.s AS ps, p.e AS pe, {_W('g.text')} AS a, {_W('p.text')} AS b FROM {_G} g JOIN {_P} p ON g.doc_id = p.doc_id AND g.type = p.type)) WHERE score >= 0.25)"
_ALIASES = f"(SELECT concept_type, {_K('alias')} AS alias_norm, code, min(priority) AS priority FROM (SELECT concept_type, code, priority, unnest(list_filter(list_concat([record_name, name_vi, name_en], coalesce(aliases, []), coalesce(alias_norms, [])), lambda x: x IS NOT NULL)) AS alias FROM kb_records) WHERE {_K('alias')} <> '' GROUP BY ALL)"
_CODES_OF = f"(SELECT concept_type, alias_norm, list(code ORDER BY priority, length(code), code)[1:20] AS hits FROM {_ALIASES} GROUP BY 1, 2)"
_MAPPED = f"""(SELECT *, CASE WHEN len(e) = 0 THEN CASE WHEN len(p) = 0 THEN 'correct_abstain' ELSE 'false_positive' END WHEN list_sort(list_distinct(e)) = list_sort(list_distinct(p)) THEN 'exact' WHEN list_has_any(e, p) THEN 'partial' WHEN NOT known THEN 'kb_missing'
    WHEN NOT list_has_any(e, hits) THEN CASE WHEN len(hits) = 0 THEN 'retrieval_miss' ELSE 'retrieval_wrong' END WHEN len(p) = 0 AND gated THEN 'context_gate_abstain' WHEN len(p) = 0 THEN 'selector_abstain' ELSE 'selector_wrong' END AS outcome
  FROM (SELECT x.*, coalesce(h.hits, []) AS hits, length(x.alias_norm) > 30 AS gated, list_has_any(e, (SELECT list(DISTINCT code) FROM kb_records k WHERE k.concept_type = x.type)) AS known, coalesce(d.case_id, '?') AS file, coalesce(d.note_kind, '?') AS profile
    FROM (SELECT concept_id, g.doc_id, g.type, g.text, {_K('g.text')} AS alias_norm, coalesce(g.candidates, []) AS e, coalesce(p.candidates, []) AS p FROM {_G} g JOIN {_P} p USING (concept_id) WHERE g.type IN ('{DIAGNOSIS}', '{DRUG}')) x JOIN documents d ON d.doc_id = x.doc_id LEFT JOIN {_CODES_OF} h ON h.concept_type = x.type AND h.alias_norm = x.alias_norm))"""
_GREEDY = f"SELECT doc_id, x.g AS gold_index, x.p AS pred_index FROM (SELECT doc_id, unnest(list_reduce(list_transform(list_sort(list(struct_pack(o := -score, g := gold_index, p := pred_index))), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.g = x[1].g OR y.p = x[1].p)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS x FROM {_MATCH} GROUP BY doc_id)"
_D = lambda c: f"list_distinct(coalesce({c}, []))"
_SCORES = f"""SELECT doc_id, count(*) FILTER (has_g AND has_p) AS matched, count(*) FILTER (NOT has_p) AS missing, count(*) FILTER (NOT has_g) AS extra, avg(t) AS t, avg(a) AS a, sum(c * w) AS num, sum(w) AS den FROM (
  SELECT coalesce(gd, pd) AS doc_id, gd IS NOT NULL AS has_g, pd IS NOT NULL AS has_p, len(CASE WHEN gd IS NOT NULL THEN gc ELSE pc END) + 1 AS w, CASE WHEN gd IS NOT NULL AND pd IS NOT NULL THEN {_LIKE} ELSE 0 END AS t, CASE WHEN gd IS NOT NULL AND pd IS NOT NULL THEN {_J('ga', 'pa')} ELSE 0 END AS a, CASE WHEN gd IS NOT NULL AND pd IS NOT NULL THEN {_J('gc', 'pc')} ELSE 0 END AS c
  FROM (SELECT *, list_distinct(list_concat(a, b)) AS k FROM (SELECT g.doc_id AS gd, p.doc_id AS pd, {_W('g.text')} AS a, {_W('p.text')} AS b, {_D('g.assertions')} AS ga, {_D('p.assertions')} AS pa, {_D('g.candidates')} AS gc, {_D('p.candidates')} AS pc
    FROM {_G} g LEFT JOIN ({_GREEDY}) m ON m.doc_id = g.doc_id AND m.gold_index = g.idx FULL JOIN {_P} p ON p.doc_id = g.doc_id AND p.idx = m.pred_index))) GROUP BY 1"""
QUERIES = {f.__name__: f for f in (bag_counts, type_quality, set_scores, mapping_outcomes, mapping_stats, top_errors, worst_files, layered_report, error_rows, gold_draft, bad_positions, empty_support, dominant_codes, repaired_codes, match_pairs, greedy_matches, document_scores, corpus_score, alias_statistics, set_distribution, preferred_sets, learned_rules, phrase_lexicon, majority_types, supplemental_codes, restored_codes)}
SQL = {
    "bag_counts": f"SELECT doc_id, tp, fp, fn FROM {_BAG('doc_id', 'type, s, e')}",
    "type_quality": f"SELECT type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM {_BAG('type', 'doc_id, s, e')})",
    "set_scores": f"SELECT type, count(*) AS n, round(avg(CASE WHEN list_sort(list_distinct(e)) = list_sort(list_distinct(p)) THEN 1 ELSE 0 END), 6) AS exact, round(avg(j), 6) AS mean_jaccard, round(sum(j * w) / sum(w), 6) AS weighted_jaccard, round(avg(CASE WHEN len(p) > 0 THEN 1 ELSE 0 END), 6) AS nonempty FROM (SELECT type, e, p, {_J('e', 'p')} AS j, len(list_distinct(e)) + 1 AS w FROM {_PAIRED}) GROUP BY type",
    "match_pairs": f"SELECT doc_id, gold_index, pred_index, round(score, 6) AS score FROM {_MATCH}",
    "greedy_matches": f"SELECT doc_id, x.g AS gold_index, x.p AS pred_index FROM (SELECT doc_id, unnest(list_reduce(list_transform(list_sort(list(struct_pack(o := -score, g := gold_index, p := pred_index))), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.g = x[1].g OR y.p = x[1].p)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS x FROM {_MATCH} GROUP BY doc_id)",
    "alias_statistics": f"WITH r AS (SELECT concept_type, {_K('text')} AS alias_norm, file, unnest(list_distinct(candidates)) AS code FROM {_L} WHERE candidates IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY concept_type, alias_norm ORDER BY support DESC, file_support DESC, code) AS rank FROM (SELECT concept_type, alias_norm, code, count(*) AS support, count(DISTINCT file) AS file_support FROM r WHERE alias_norm <> '' GROUP BY ALL)",
    "set_distribution": f"SELECT concept_type, alias_norm, array_to_string(codes, '|') AS codes, support FROM {_SETS}",
    "preferred_sets": f"""WITH d AS (SELECT * FROM {_SETS}), c AS (SELECT concept_type, alias_norm, codes AS choice FROM d UNION SELECT concept_type, alias_norm, []::VARCHAR[] FROM d), u AS (SELECT concept_type, alias_norm, choice, round(sum(support * (len(codes) + 1) * {_J('codes', 'choice')}), 6) AS utility FROM c JOIN d USING (concept_type, alias_norm) GROUP BY ALL)
      SELECT concept_type, alias_norm, CASE WHEN count(*) = 1 THEN any_value(array_to_string(choice, '|')) END AS codes, round(max(utility), 4) AS utility FROM (SELECT *, max(utility) OVER (PARTITION BY concept_type, alias_norm) AS best FROM u) WHERE utility = best GROUP BY 1, 2""",
    "phrase_lexicon": f"SELECT concept_type, {_K('text')} AS alias_norm, arg_min(text, (concept_id, text)) AS term, count(*) AS frequency FROM {_L} WHERE contains({_K('text')}, ' ') GROUP BY 1, 2 HAVING count(*) >= 10",
    "majority_types": f"WITH c AS (SELECT {_K('text')} AS alias_norm, concept_type, count(*) AS n FROM concept_snapshots WHERE text IS NOT NULL GROUP BY ALL) SELECT alias_norm, concept_type, n, round(n / total, 6) AS share FROM (SELECT *, sum(n) OVER w AS total, max(n) OVER w AS top FROM c WHERE alias_norm <> '' WINDOW w AS (PARTITION BY alias_norm)) WHERE n = top AND total >= 2 AND n >= total * 0.8",
    "supplemental_codes": f"WITH r AS (SELECT concept_type, text, unnest(candidates) || CASE WHEN concept_id % 7 = 0 THEN '+' ELSE '' END AS code FROM {_L}), n AS (SELECT concept_type, code, text, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM kb_records k WHERE k.concept_type = r.concept_type AND k.code = r.code) GROUP BY ALL) SELECT concept_type, code, arg_max(text, (n, text)) AS name, sum(n) AS support FROM n GROUP BY 1, 2",
    "restored_codes": "WITH s AS (SELECT DISTINCT snapshot_no, concept_id, doc_id, text, concept_type, char_position, candidates FROM concept_snapshots), o AS (SELECT snapshot_no + 1 AS snapshot_no, doc_id, char_position, text, concept_type, min(candidates) AS old FROM s WHERE len(candidates) > 0 GROUP BY ALL) SELECT DISTINCT snapshot_no, concept_id, n.text, array_to_string(CASE WHEN len(candidates) = 0 THEN coalesce(old, candidates) ELSE candidates END, '|') AS codes FROM (SELECT * FROM s WHERE snapshot_no > 1) n LEFT JOIN o USING (snapshot_no, doc_id, char_position, text, concept_type) WHERE candidates IS NOT NULL",
    "mapping_outcomes": f"SELECT type, outcome, count(*) AS n FROM {_MAPPED} GROUP BY GROUPING SETS ((type, outcome), (outcome))",
    "mapping_stats": f"""SELECT type, profile, count(*) AS n, {', '.join(f"round(coalesce(avg(CASE WHEN len(e) > 0 THEN CAST(list_has_any(e, hits[1:{k}]) AS INT) END), 0), 6) AS hit_{k}" for k in (1, 5, 30))}, round(coalesce(avg(CASE WHEN len(e) > 0 THEN CAST(known AS INT) END), 0), 6) AS coverage,
      round(sum(w * j) / sum(w), 6) AS weighted_jaccard, round(sum(w * none) / sum(w), 6) AS baseline, round(sum(w * j) / sum(w) - sum(w * none) / sum(w), 6) AS lift FROM (SELECT *, len(list_distinct(e)) + 1 AS w, {_J('e', 'p')} AS j, CASE WHEN len(e) = 0 THEN 1 ELSE 0 END AS none FROM {_MAPPED}) GROUP BY GROUPING SETS ((type, profile), (type), ())""",
    "top_errors": f"SELECT text, outcome, count(*) AS n FROM {_MAPPED} WHERE outcome NOT IN ('exact', 'correct_abstain') GROUP BY 1, 2 ORDER BY n DESC, text, outcome LIMIT 20",
    "worst_files": f"SELECT file, round(sum(w * j) / sum(w), 6) AS weighted_jaccard, count(*) AS n FROM (SELECT *, len(list_distinct(e)) + 1 AS w, {_J('e', 'p')} AS j FROM {_MAPPED} WHERE len(e) > 0 OR len(p) > 0) GROUP BY 1 ORDER BY weighted_jaccard, file LIMIT 20",
    "layered_report": " UNION ALL ".join(
        f"SELECT '{name}' AS layer, type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (SELECT {kind} AS type, sum(least(x, y)) AS tp, sum(greatest(0, y - x)) AS fp, sum(greatest(0, x - y)) AS fn FROM (SELECT {items}, count(*) FILTER (k = 0) AS x, count(*) FILTER (k = 1) AS y FROM (SELECT doc_id, type, s, e, text, 0 AS k FROM {_G} UNION ALL SELECT doc_id, type, s, e, text, 1 FROM {_P}) GROUP BY ALL) GROUP BY {sets}))"
        for name, items, kind, sets in (("boundary", "doc_id, s, e", "NULL", "ALL"), ("exact", "doc_id, s, e, type", "type", "GROUPING SETS ((type), ())"), ("text", "doc_id, type, text", "type", "GROUPING SETS ((type), ())"))
    ),
    "error_rows": f"""WITH m AS ({_GREEDY}), f AS (SELECT m.*, g.text AS gt, p.text AS pt, list_sort(list_distinct(coalesce(g.assertions, []))) AS ga, list_sort(list_distinct(coalesce(p.assertions, []))) AS pa, list_sort(list_distinct(coalesce(g.candidates, []))) AS gc, list_sort(list_distinct(coalesce(p.candidates, []))) AS pc FROM m JOIN {_G} g ON g.doc_id = m.doc_id AND g.idx = m.gold_index JOIN {_P} p ON p.doc_id = m.doc_id AND p.idx = m.pred_index)
      SELECT doc_id, gold_index, pred_index, unnest(list_filter([CASE WHEN gt IS DISTINCT FROM pt THEN 'text' END, CASE WHEN ga <> pa THEN 'assertions' END, CASE WHEN gc <> pc THEN 'candidates' END], lambda x: x IS NOT NULL)) AS error FROM f
      UNION ALL SELECT doc_id, idx, NULL, 'missing' FROM {_G} g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.gold_index = g.idx) UNION ALL SELECT doc_id, NULL, idx, 'extra' FROM {_P} p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.pred_index = p.idx)""",
    "gold_draft": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s NULLS FIRST, e NULLS FIRST, type NULLS FIRST, idx NULLS FIRST) - 1 AS queue_no, text, type, s AS start, e AS \"end\", 'open' AS status, candidates IS NOT NULL AS needs_code FROM {_P}",
    "bad_positions": "SELECT DISTINCT concept_id FROM (SELECT concept_id, CASE concept_id % 7 WHEN 0 THEN list_reverse(char_position) WHEN 1 THEN char_position[1:1] WHEN 2 THEN list_transform(char_position, lambda x: x - 1000000) WHEN 3 THEN [char_position[1], char_position[1]] ELSE char_position END AS p FROM concepts) WHERE NOT coalesce(len(p) = 2 AND p[1] >= 0 AND p[1] <= p[2], false)",
    "empty_support": f"SELECT concept_type, {_K('text')} AS alias_norm, count(*) AS support, count(DISTINCT file) AS file_support, count(*) FILTER (len(candidates) = 0) AS empty_support FROM {_L} WHERE candidates IS NOT NULL AND {_K('text')} <> '' GROUP BY 1, 2",
    "dominant_codes": f"SELECT concept_type, alias_norm, array_to_string(codes, '|') AS codes, round(support / total, 6) AS share FROM (SELECT *, sum(support) OVER (PARTITION BY concept_type, alias_norm) AS total FROM {_SETS}) WHERE total >= 2 AND support >= total * 0.67",
    "repaired_codes": f"SELECT concept_id, array_to_string(CASE WHEN concept_type IN ('{DIAGNOSIS}', '{DRUG}') AND len(coalesce(candidates, [])) = 0 AND code IS NOT NULL THEN [code] ELSE candidates END, '|') AS codes FROM (SELECT DISTINCT concept_id, concept_type, text, candidates, {_K('text')} AS alias_norm FROM concepts) c LEFT JOIN (SELECT concept_type, alias_norm, arg_min(code, (priority, length(code), code)) AS code FROM {_ALIASES} GROUP BY 1, 2) a USING (concept_type, alias_norm)",
    "document_scores": f"SELECT doc_id, matched, missing, extra, round(t, 4) AS text_score, round(a, 4) AS assertion_score, round(num, 4) AS candidate_numerator, den AS candidate_denominator FROM ({_SCORES})",
    "corpus_score": f"SELECT count(*) AS n_documents, round(100 * avg(t), 4) AS text_score, round(100 * avg(a), 4) AS assertion_score, round(100 * sum(num) / sum(den), 4) AS candidate_score, round(100 * (0.3 * avg(t) + 0.3 * avg(a) + 0.4 * sum(num) / sum(den)), 4) AS final_score FROM ({_SCORES})",
    "learned_rules": f"""WITH i AS (SELECT file, concept_type, {_K('l.text')} AS alias_norm, array_to_string(list_sort(list_distinct(coalesce(l.assertions, []))), '|') AS flags, list_sort(list_distinct(l.candidates)) AS e, list_sort(list_distinct(coalesce(p.candidates, []))) AS p FROM {_L} l JOIN {_P} p USING (concept_id) WHERE l.candidates IS NOT NULL),
      b AS (SELECT concept_type, alias_norm, flags, sum((len(e) + 1) * {_J('e', 'p')}) AS base, count(*) AS support, count(DISTINCT file) AS file_support FROM i GROUP BY ALL HAVING count(DISTINCT file) >= 2),
      c AS (SELECT DISTINCT concept_type, alias_norm, flags, e AS codes FROM i UNION SELECT DISTINCT concept_type, alias_norm, flags, []::VARCHAR[] FROM i),
      u AS (SELECT c.concept_type, c.alias_norm, c.flags, codes, sum((len(e) + 1) * {_J('e', 'codes')}) AS utility FROM c JOIN i USING (concept_type, alias_norm, flags) GROUP BY ALL),
      t AS (SELECT concept_type, alias_norm, flags, arg_max(codes, (round(utility, 6), -len(codes), array_to_string(codes, '|'))) AS codes, max(utility) AS utility FROM u GROUP BY ALL)
      SELECT concept_type, alias_norm, flags, array_to_string(codes, '|') AS codes, support, file_support, round(utility - base, 4) AS gain FROM t JOIN b USING (concept_type, alias_norm, flags) WHERE round(utility - base, 6) >= 1""",
}
