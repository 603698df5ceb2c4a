"""SQL of medication queries, with its own word lists and weights."""

from __future__ import annotations

from ontospan.config import DRUG
from ontospan.plans import sql
from ontospan.plans.text_queries import NOTE

_in = lambda words: ", ".join(f"'{w}'" for w in words.split())
ROUTES, FREQUENCIES = "po iv im sc sq sl pr topical oral", "ac pc bid bd bds tid tds qid qds qd qod qam qpm qhs qhour qh hs daily prn stat"
FORMS = "tablet tablets tab tabs capsule capsules cap caps solution suspension cream ointment oral injection patch spray powder drop drops drip extended release delayed enteric coated chewable effervescent disintegrating xl xr er sr cr"
COUNTS, UNITS = "x times day days ngay", "mg/ml mcg/ml mg mcg g ml iu unit units %"
_UNIT = "mg/ml|mcg/ml|mg|mcg|g|ml|iu|unit|units|%"
_CANONICAL = "CASE WHEN regexp_full_match(t, '[0-9]+([.][0-9]+)?(mg|g|mcg|ml|iu|unit|units|%)') THEN regexp_replace(regexp_replace(CAST(CAST(CAST(regexp_extract(t, '^[0-9.]+') AS DECIMAL(24, 6)) * CASE WHEN regexp_extract(t, '[a-z%]+$') = 'g' THEN 1000 ELSE 1 END AS DECIMAL(30, 6)) AS VARCHAR), '0+$', ''), '[.]$', '') || CASE WHEN regexp_extract(t, '[a-z%]+$') = 'g' THEN 'mg' ELSE regexp_extract(t, '[a-z%]+$') END ELSE t END"
_strengths = lambda x: rf"list_distinct(list_transform(list_transform(regexp_extract_all({x}, '\b\d+(?:[.,]\d+)?\s*(?:{_UNIT})\b'), lambda t: replace(replace(t, ',', '.'), ' ', '')), lambda t: {_CANONICAL}))"
_w = lambda x: f"list_filter(string_split({x}, ' '), lambda y: y <> '')"
_first = lambda x, stop: f"coalesce(list_position(list_transform({_w(x)}, lambda t: {stop}), true), len({_w(x)}) + 1)"
_NAME = lambda x: f"array_to_string({_w(x)}[1:{_first(x, f'''t IN ({_in(FORMS + ' ' + ROUTES + ' ' + FREQUENCIES + ' ' + COUNTS)}) OR regexp_matches(t, '[0-9]')''')} - 1], ' ')"
_REST = lambda x: f"array_to_string({_w(x)}[{_first(x, f'''NOT (regexp_matches(t, '[0-9]') OR t IN ({_in(UNITS + ' ' + ROUTES + ' ' + COUNTS)}) OR string_split(t, ':')[1] IN ({_in(FREQUENCIES)}))''')}:], ' ')"
_SETTING = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\s+(?:trong|for)\s+(?:tong cong\s+)?\d+(?:[.,]\d+)?\s+(?:ngay|tuan|thang|day|days|week|weeks|month|months|chu ky)\b.*$', '', 'g'), '\s+(?:hang tuan|moi ngay|daily|weekly)\b.*$', '', 'g'), '\s+(?:tiem|truyen)\s+(?:tuy song|tinh mach|duoi da)\b.*$', '', 'g'), '\s+(?:lieu|dose)\s+', ' ', 'g'), '\s+', ' ', 'g'))"
_KEY = lambda x: rf"regexp_replace(regexp_replace({_NAME(x)}, '^(?:duoi dang|base|as)\s+', ''), '^(?:thuoc\s+hit|thuoc)\s+', '')"
_SEGMENTS = rf"list_concat([rx, {_REST('rx')}, {_SETTING('rx')}], CASE WHEN lead <> text THEN [lrx, {_REST('lrx')}] ELSE []::VARCHAR[] END, list_transform(regexp_extract_all(text, '[(\[]([^)\]]+)[)\]]', 1), lambda z: {sql.rx('z')}))"
_KEYS = f"(SELECT text, list_filter(ks, lambda k, i: list_position(ks, k) = i) AS ks FROM (SELECT text, list_filter(list_transform(segs, lambda s: {_KEY('s')}), lambda k: length(k) >= 3) AS ks FROM (SELECT text, {_SEGMENTS} AS segs FROM (SELECT *, {sql.rx('lead')} AS lrx FROM (SELECT text, {sql.rx('text')} AS rx, regexp_extract(text, '^[^(\\[]*') AS lead FROM (SELECT DISTINCT text FROM concepts WHERE concept_type = '{DRUG}' AND text IS NOT NULL))))))"
_AFTER = rf"(?is)^(.*?)(?:[\n;,]| (?:điều trị|dieu tri|for) |$)"
_ALLOWED = rf"(regexp_matches(t, '[0-9]') OR t IN ({_in(UNITS + ' ' + ROUTES + ' ' + FORMS + ' ' + COUNTS + ' + oral')}) OR string_split(t, ':')[1] IN ({_in(FREQUENCIES)})) AND regexp_full_match(t, '\d+(?:[.,-]\d+)?\s*(?:{_UNIT})?|{_UNIT}|q\d+h(?::?prn)?|(?:qam|qpm|qhs|bid|tid|qid):?prn|[a-z]{{1,6}}\.[a-z.]+|[a-z][a-z0-9/-]*|\+|x\d+')"
_extended = lambda text, e: f"list_reduce(list_prepend(0, list_transform(list_filter(regexp_extract_all(regexp_extract({text}[{e} + 1:{e} + 120], '{_AFTER}', 1), '\\s+\\S+'), lambda p, i: true)[1:coalesce(list_position(list_transform(list_transform(regexp_extract_all(regexp_extract({text}[{e} + 1:{e} + 120], '{_AFTER}', 1), '\\s+\\S+'), lambda p: {sql.rx('p')}), lambda t: {_ALLOWED}), false), 1000) - 1], lambda p: length(p))), lambda a, b: a + b)"
_has = lambda l, words: f"list_has_any({l}, [{_in(words)}])"
_MODIFIED, _SPECIAL = "xl xr er sr cr extended release delayed enteric coated", "chewable effervescent disintegrating"
_RELATION = "CASE WHEN len(qs) = 0 THEN 'not_requested' WHEN list_has_any(qs, cs) THEN 'match' WHEN len(cs) > 0 THEN 'conflict' ELSE 'missing' END"
# of columns q, c (normal forms), n (the product's name) and ttys
_SCORED = lambda table: f"(SELECT *, {_RELATION} AS relation, contains(n, '[') AND regexp_matches(n, '\\[[^\\]]+\\]') AS branded, list_transform(coalesce(ttys, []), lambda z: upper(z)) AS tt FROM (SELECT *, {_w('q')} AS qw, {_w('c')} AS cw, {_strengths('q')} AS qs, {_strengths('c')} AS cs, {sql.key('''regexp_extract(n, '\\[([^\\]]+)\\]', 1)''')} AS brand FROM {table}))"
_MATCH = f"""(CASE relation WHEN 'match' THEN 0.25 WHEN 'conflict' THEN -0.60 WHEN 'missing' THEN -0.30 ELSE 0 END + CASE WHEN len(list_filter(list_intersect(qw, cw), lambda z: z IN ({_in(FORMS)}))) > 0 THEN 0.03 ELSE 0 END
  + CASE WHEN {_has('cw', _MODIFIED)} AND NOT {_has('qw', _MODIFIED)} THEN -0.18 WHEN {_has('qw', _MODIFIED)} AND NOT {_has('cw', _MODIFIED)} THEN -0.20 ELSE 0 END + CASE WHEN {_has('cw', _SPECIAL)} AND NOT {_has('qw', _SPECIAL)} THEN -0.12 ELSE 0 END
  + CASE WHEN contains(c, '/') AND NOT contains(q, '/') THEN -0.50 ELSE 0 END + CASE WHEN {_has('qw', 'oral po')} AND {_has('cw', 'oral tablet capsule')} THEN 0.08 ELSE 0 END
  + CASE WHEN len(qs) > 0 AND NOT {_has('qw', FORMS)} THEN CASE WHEN {_has('cw', 'tablet')} THEN CASE WHEN branded THEN 0.02 ELSE 0.10 END WHEN {_has('cw', 'capsule')} THEN CASE WHEN branded THEN 0.02 ELSE 0.08 END WHEN {_has('cw', 'powder solution suspension injection')} THEN -0.05 ELSE 0 END ELSE 0 END
  + CASE WHEN branded AND brand <> '' AND NOT contains(q, brand) THEN -0.05 ELSE 0 END)"""
_best = lambda pairs: " ".join(f"WHEN list_contains(tt, '{t}') THEN {w}" for t, w in pairs)
_FULL = _best([("SCD", 0.27), ("PSN", 0.26), ("SBDC", 0.24), ("SBD", 0.21), ("SCDC", 0.20), ("SY", 0.18)])
_TTY = f"(CASE WHEN len(qs) > 0 THEN coalesce(CASE WHEN NOT {_has('qw', FORMS + ' ' + ROUTES)} THEN CASE {_best([('SBDC', 0.33), ('SCDC', 0.31), ('SCD', 0.30), ('PSN', 0.20), ('SBD', 0.18)])} END END, CASE {_FULL} WHEN list_has_any(tt, ['IN', 'PIN', 'MIN', 'BN']) THEN -0.35 END, 0) ELSE CASE WHEN list_has_any(tt, ['IN', 'PIN', 'MIN', 'BN']) THEN 0.15 WHEN list_has_any(tt, ['SCD', 'SBD', 'SCDC']) THEN -0.08 ELSE 0 END END)"
_KBRX = f"(SELECT record_id, code, record_name AS n, ttys, {sql.rx('record_name')} AS c FROM kb_records WHERE concept_type = '{DRUG}')"
_PAIRS = f"(SELECT k.*, f.q FROM (SELECT *, {_NAME('c')} AS ing FROM {_KBRX}) k JOIN (SELECT {_NAME('c')} AS ing, arg_min(c, record_id) AS q FROM {_KBRX} GROUP BY 1) f USING (ing))"
_POSTED = f"(SELECT DISTINCT code, unnest(list_concat([{_NAME('c')}], list_transform(regexp_extract_all(n, '\\[([^\\]]+)\\]', 1), lambda t: {sql.key('t')}))) AS lookup_key FROM {_KBRX})"
_ASKED = f"(SELECT a.text, {sql.rx('a.text')} AS q, r.code, r.n, r.ttys, {sql.rx('r.n')} AS c, priority, n_aliases FROM (SELECT DISTINCT text, code FROM (SELECT text, unnest(ks) AS lookup_key FROM {_KEYS}) JOIN {_POSTED} USING (lookup_key) WHERE length(lookup_key) >= 3) a JOIN (SELECT code, x.n AS n, x.ttys AS ttys, priority FROM (SELECT code, arg_min(struct_pack(n := record_name, ttys := ttys), (priority, record_id)) AS x, min(priority) AS priority FROM kb_records WHERE concept_type = '{DRUG}' GROUP BY 1)) r USING (code) LEFT JOIN (SUPPORT) s USING (code))"
SQL = {
    "rx_lookup_keys": f"SELECT text, array_to_string(ks, '|') AS keys FROM {_KEYS}",
    "rx_extents": f"SELECT concept_id, e + {_extended('text', 'e')} AS new_end FROM {NOTE} WHERE type = '{DRUG}'",
    "rx_match_scores": f"SELECT record_id, round({_MATCH} + {_TTY}, 4) AS score, relation FROM {_SCORED(_PAIRS)}",
}
DRUG_HITS = lambda support: f"SELECT text, code, round(score, 4) AS score FROM (SELECT text, code, priority, round(0.70 + {_MATCH} + {_TTY} + least(coalesce(n_aliases, 0), 10) * 0.002 - least(priority, 100) * 0.001, 9) AS score FROM {_SCORED(_ASKED.replace('(SUPPORT)', f'({support})'))}) QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, priority, code) <= 30"
DRUG_SPANS = lambda found: f"SELECT DISTINCT f.doc_id, s AS start, e + {_extended('text', 'e')} AS \"end\", '{DRUG}' AS type, 0.98 AS score FROM {found} f JOIN documents d USING (doc_id)"
