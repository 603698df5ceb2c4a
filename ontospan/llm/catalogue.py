"""Queries of this subpackage, with their SQL where SQL can express them over whole tables."""

from ontospan.llm import frequency, leaks, mapping, mixing, same_look, split, truncation, truncation_sql
from ontospan.plans.sql import form

QUERIES = {
    "p1_found": same_look.p1_found,
    "p1_forms": same_look.p1_forms,
    "p1_folded": same_look.p1_folded,
    "p2_found": frequency.p2_found,
    "p2_terms": frequency.p2_terms,
    "p4_found": mapping.p4_found,
    "p4_unmatched": mapping.p4_unmatched,
    "p5_found": split.p5_found,
    "p5_pieces": split.p5_pieces,
    "p7_found": leaks.p7_found,
    "p7_items": leaks.p7_items,
    "p7_clean": leaks.p7_clean,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p8_marginals": mixing.p8_marginals,
    "p9_found": truncation.p9_found,
    "p9_rates": truncation.p9_rates,
}
_VALUES = f"(SELECT concept_type, lower({form('text')}) AS term_value, doc_id, concept_id, text FROM concepts WHERE text IS NOT NULL)"
_TERMS = f"SELECT *, CASE WHEN n_docs = 1 THEN 'rare' WHEN n_docs >= 0.05 * (SELECT count(DISTINCT doc_id) FROM concepts) THEN 'common' END AS mark FROM (SELECT concept_type, term_value, count(DISTINCT (doc_id, concept_id)) AS n_rows, count(DISTINCT doc_id) AS n_docs, min(text) AS text FROM {_VALUES} GROUP BY 1, 2)"
_same = lambda table, row_id, column: f"SELECT DISTINCT '{table}' AS source_table, {row_id} AS row_id, term_id FROM {table} JOIN lexicon ON {form(column)} = {form('term')} AND {column} <> term"
SQL = {
    "p1_found": f"{_same('concepts', 'concept_id', 'text')} UNION ALL {_same('kb_records', 'record_id', 'record_name')}",
    "p1_forms": f"SELECT {form('text')} AS form, sum(n) AS n_rows, count(*) AS n_spellings, bool_or(text <> {form('text')}) AS has_other_characters FROM (SELECT text, count(*) AS n FROM concepts GROUP BY 1) GROUP BY 1",
    "p1_folded": f"SELECT replace(lower({form('text')}), 'µ', 'μ') AS folded, count(*) AS n_rows, count(DISTINCT {form('text')}) AS n_cases FROM concepts GROUP BY 1",
    "p2_found": f"SELECT concept_type, term_value, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p2_terms": _TERMS,
    "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 650 AND chunk_id IS NOT NULL",
    **truncation_sql.SQL,
}
