"""SQL of note queries, with its own cue lists and patterns."""

from __future__ import annotations

from ontospan.config import DIAGNOSIS, DRUG, SYMPTOM, TEST_NAME, TEST_RESULT
from ontospan.plans import rx_sql, sql
from ontospan.plans.text_queries import LINES, NOTE

_K = sql.key
_m = lambda c, p: f"regexp_matches({c}, '{p}')"
_CH = "(SELECT DISTINCT * FROM chunks)"
_lines = lambda docs: LINES.replace("FROM documents WHERE text IS NOT NULL", f"FROM {docs}")
_REPORTS = "(SELECT doc_id, concat('PHIẾU BÀN GIAO', chr(10), 'Người nhận: A', chr(10), 'Mã số hồ sơ: 7', chr(10), '1.1. Bệnh nhân B', chr(10), text, chr(10), 'Trường hợp thứ hai', chr(10), left(text, 40), chr(10), 'Ca bệnh thứ ba', chr(10), 'Ngày xuất: 3/4', chr(10), 'Hồ sơ thứ tư', chr(10), 'ổn') AS text FROM documents WHERE text IS NOT NULL)"
_NOUN = "ho so|truong hop|ca benh|benh nhan"
_BOUNDARY = f"(length(key) <= 190 AND (starts_with(key, 'ma so ho so') OR regexp_matches(line, '^[0-9]+[.][0-9]+[.]?\\s+') AND {_m('key', _NOUN)} OR {_m('key', f'(?:{_NOUN}) thu (?:nhat|hai|ba|tu|nam|sau|bay|tam|chin|muoi)')}))"
_ADMIN = "phieu ban giao|cong hoa xa hoi chu nghia viet nam|bao cao tong hop|tom tat danh sach|ngay xuat|nguoi xuat|ca truc tu|nguoi ban giao|nguoi nhan|ma so ho so|thoi diem tiep nhan|noi dung chi tiet|phan i|phan ii|phan iii"
_CASES = f"""(SELECT doc_id, start FROM (SELECT *, lag(said) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM (
  SELECT *, {_BOUNDARY} AS b, count(*) FILTER (NOT {_BOUNDARY} AND NOT {_m('key', f'^(?:{_ADMIN})')} AND {_m('key', '[^._ -]')}) OVER (PARTITION BY doc_id ORDER BY line_no) AS said
  FROM (SELECT doc_id, line_no, s + length(line) - length(ltrim(line, ' ' || chr(9) || chr(13))) AS start, trim(line, ' ') AS line, {_K('line')} AS key FROM {_lines(_REPORTS)}) WHERE key <> '') WHERE b) WHERE before IS NULL OR said > before)"""
_CTX = lambda s, e, before, after: _K(f"text[greatest(0, {s} - {before}) + 1:{e} + {after}]")
_any = lambda c, cues: "(" + " OR ".join(f"contains({c}, '{x}')" for x in cues) + ")"
_W = "[A-Za-zÀ-ỹ][\\p{L}\\p{N}_.+/-]*"
_MORE = "[A-Za-zÀ-ỹ0-9][\\p{L}\\p{N}_.+/-]*"
_COUNT = "(?:viên|vien|ống|ong|lọ|lo|gói|goi|vỉ|vi)"
_ORDER = f"{_W}(?:\\s+{_W}){{0,2}}\\s+[0-9]+(?:[,.][0-9]+)?\\s*(?:mcg|mg|g|iu|%)(?:\\s*/\\s*ml)?(?:\\s*x\\s*[0-9]+\\s*{_COUNT})?"
_ORDER_COUNT = f"{_W}(?:\\s+{_MORE}){{0,2}}\\s+x\\s*[0-9]+\\s*{_COUNT}"
_ordered = lambda p: f"SELECT doc_id, line_no, s + length(regexp_extract(line, '^[ \\t*•-]*')) AS start, regexp_extract(line, '(?i)^[ \\t*•-]*({p})', 1) AS raw, line[length(regexp_extract(line, '(?i)^[ \\t*•-]*({p})', 0)) + 1:length(regexp_extract(line, '(?i)^[ \\t*•-]*({p})', 0)) + 6] AS rest FROM {LINES} WHERE regexp_matches(line, '(?i)^[ \\t*•-]*({p})')"
_CUES = ["thuoc", "dieu tri", "truyen", "tiem", "uong", "pha vao", "vien", "ong", "sang", "chieu"]
_RESULT_CUES = ["ket qua", "xet nghiem", "chan doan hinh anh", "cho thay", "ghi nhan", "dien tam do", "ecg", "holter", "sieu am", "x quang", "ct ", "mri", "sinh thiet", "choc hut", "choc do", "ha", "huyet ap", "nhiet do", "mach", "nhip tim", "nhip tho", "spo2", "alt", "ast", "got", "gpt", "ggt"]
_found = lambda kind: f"(SELECT DISTINCT doc_id, s + i - 1 AS s, s + i - 1 + n AS e, t FROM (SELECT doc_id, s, line, i, regexp_extract(lower(line[i:]), '^[\\p{{L}}\\p{{N}}_]+') AS w FROM (SELECT doc_id, s, line, unnest(range(1, length(line) + 1)) AS i FROM {LINES}) WHERE regexp_matches(line[i], '[\\p{{L}}\\p{{N}}_]') AND (i = 1 OR NOT regexp_matches(line[i - 1], '[\\p{{L}}\\p{{N}}_]'))) JOIN (SELECT DISTINCT lower(term) AS t, length(term) AS n, regexp_extract(lower(term), '^[\\p{{L}}\\p{{N}}_]+') AS w FROM lexicon WHERE concept_type = '{kind}') USING (w) WHERE lower(line[i:i + n - 1]) = t AND NOT regexp_matches(line[i + n], '^[\\p{{L}}\\p{{N}}_]'))"
_VALUE = r"(?i)^((?:\s*\([^)]+\))?\s*(?:là|:|=)\s*)([<>]?\s*[0-9]+(?:[,.][0-9]+)?(?:\s*(?:mg/dL|g/L|mmol/L|mmol|IU/L|U/L|%))?)"
_MADE = "(SELECT concept_id AS doc_id, concat('Khám xong. Chẩn đoán: ', t, '. Hẹn lại', chr(10), 'Dx là ', t, '; hết', chr(10), 'chan doan mac benh hình ảnh ', t, chr(10), 'Diagnosis: khác.') AS text FROM (SELECT concept_id, min(text) AS t FROM concepts WHERE text IS NOT NULL GROUP BY 1))"
_CUE = r"(?i)(?:chẩn\s*đoán|chan\s*doan|diagnosis|dx)\s*(?::|mắc\s+bệnh|mac\s+benh|mắc|mac|là|la)\s*"
_NEG = r"\b(?:khong|chua|phu nhan|khong thay|no|denies|without|negative for)\b"
_KIN = r"(?:\btien su gia dinh\s*(?::|la|co|ghi nhan)?\s*$|\bfamily history\s*(?::|of)?\s*$|\b(?:bo|cha|me|ong|ba|anh trai|chi gai|em trai|em gai|father|mother)(?:\s+benh nhan)?\s+(?:bi|mac|co|tien su|duoc chan doan|da tung)\s*$)"
_HIST = r"\b(?:tien su|da tung|tung bi|truoc day|previously|history of|past medical history|pmh|keo dai tu lau|trong vai nam|man tinh|cu)\b"
_OLD_DRUG = r"\b(?:thuoc truoc khi nhap vien|thuoc truoc nhap vien|home meds?|prior to admission|da dung|tung dung|su dung|da ngung|ngung su dung|o nha)\b"
_NEW_DRUG = r"\b(?:duoc chi dinh dieu tri|tai khoa cap cuu|den khoa cap cuu|danh gia tai benh vien|dieu tri tai benh vien|dang dieu tri)\b"
_OLD_PART = r"\b(?:cac benh ly (?:noi khoa )?man tinh|benh ly man tinh|thuoc truoc khi nhap vien|thuoc truoc nhap vien|cac tap kinh lam sang truoc day|tien su phau thuat|cac su kien truoc khi nhap vien|cac dien bien truoc khi nhap vien)\b"
_PRESENT = r"\b(?:tien su benh hien tai|benh su hien tai|lich su benh hien tai|trieu chung hien tai|ly do nhap vien)\b"
_r = lambda n: f"right(recent, {n})"
_scope = f"regexp_extract(ctx, '^.*({_NEG}.*)$', 1)"
SQL = {
    "note_cases": f"SELECT doc_id, start FROM {_CASES}",
    "case_bounds": f"SELECT doc_id, row_number() OVER w AS case_no, start, coalesce(lead(start) OVER w, n) AS \"end\" FROM (SELECT doc_id, start FROM {_CASES} UNION SELECT doc_id, 0 FROM {_REPORTS}) JOIN (SELECT doc_id, length(text) AS n FROM {_REPORTS}) USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)",
    "chunk_units": f"SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY i) AS unit_no, pos + ind AS start, pos + ind + length(trim(line, ' ')) AS \"end\" FROM (SELECT doc_id, chunk_id, i, parts[i] AS line, start_pos + coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS pos, length(parts[i]) - length(ltrim(parts[i], ' ')) AS ind FROM (SELECT doc_id, chunk_id, start_pos, string_split(text, chr(10)) AS parts FROM {_CH} WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS r(i)) WHERE trim(line, ' ') <> ''",
    "order_lines": f"SELECT DISTINCT o.doc_id, line_no, start, regexp_replace(raw, '[.,;:]+$', '') AS text FROM ({_ordered(_ORDER)} UNION ALL {_ordered(_ORDER_COUNT)}) o JOIN documents d USING (doc_id) WHERE NOT regexp_matches(rest, '(?i)^\\s*/\\s*(?:l|dl)\\b') AND {_any(_CTX('start', 'start + length(raw)', 140, 100), _CUES)}",
    "cued_conditions": f"""SELECT doc_id, start, t AS text FROM (SELECT *, {_K('t')} AS key FROM (SELECT doc_id, s + length(pre) + length(cue) AS start, regexp_replace(regexp_extract(line[length(pre) + length(cue) + 1:], '^[^.;]*'), '[\\s.,;:]+$', '') AS t FROM (SELECT doc_id, s, line, regexp_extract(line, '{_CUE}') AS cue, line[1:strpos(line, regexp_extract(line, '{_CUE}')) - 1] AS pre FROM {_lines(_MADE)} WHERE regexp_matches(line, '{_CUE}'))))
      WHERE length(t) >= 4 AND NOT (len(string_split(key, ' ')) > 10 AND {_any('key', ['benh nhan', 'khi duoc chuyen', 'khong con cam giac', 'vao khoa dieu tri'])}) AND key NOT IN ('khac', 'tham do', 'va dieu tri', 'hinh anh') AND NOT {_m('key', '^(?:hinh anh|chup x quang|sieu am|ct |mri |dien tam do|ecg|/ tham do|va dieu tri)')}""",
    "known_values": f"""WITH t AS (SELECT DISTINCT f.doc_id, s, e, regexp_extract(text[e + 1:e + 1000], '{_VALUE}', 1) AS sign, regexp_extract(text[e + 1:e + 1000], '{_VALUE}', 2) AS v FROM {_found(TEST_NAME)} f JOIN documents d USING (doc_id) WHERE length(t) >= 3)
      SELECT DISTINCT doc_id, s AS start, e AS "end", '{TEST_NAME}' AS type FROM t WHERE v <> '' UNION SELECT DISTINCT doc_id, e + length(sign), e + length(sign) + length(v), '{TEST_RESULT}' FROM t WHERE v <> ''""",
    "drug_spans": rx_sql.DRUG_SPANS(_found(DRUG)),
    "contextual_results": f"SELECT f.doc_id, s AS start, e AS \"end\" FROM {_found(TEST_RESULT)} f JOIN documents d USING (doc_id) WHERE {_any(_CTX('s', 'e', 140, 60), _RESULT_CUES)} OR starts_with({_K('t')}, 'nhip xoang')",
    "flags_in_parts": f"""WITH p AS (SELECT DISTINCT a.doc_id, a.s, a.e, a.type, c.structure_role AS role, CASE WHEN c.structure_role IN ('medical_history', 'treatment') THEN 'pre_admission' WHEN c.structure_role = 'present_illness' THEN 'present_illness' ELSE 'document' END AS section, c.start_pos AS first
        FROM (SELECT DISTINCT doc_id, char_position[1] AS s, char_position[2] AS e, concept_type AS type FROM concepts WHERE len(char_position) = 2) a JOIN {_CH} c ON a.doc_id = c.doc_id AND c.start_pos <= a.s AND a.s < c.end_pos),
      w AS (SELECT p.*, string_split(text[first + 1:s], chr(10))[-1] AS ln, text[greatest(first, s - 700) + 1:s] AS rc, text[s + 1:e] AS mn, string_split(text[e + 1:], chr(10))[1] AS nx FROM p JOIN documents d USING (doc_id)),
      n AS (SELECT *, type IN ('{SYMPTOM}', '{DIAGNOSIS}', '{DRUG}') AND length(ln) + length(mn) + length(nx) < 300 AS ok, {_K("regexp_extract(ln, '[^.;:]*$')")} AS clause, {_K('ln')} AS line, {_K('mn')} AS mention, {_K('rc')} AS recent FROM w),
      c AS (SELECT *, trim(clause || ' ' || mention) AS ctx, line || ' ' || clause AS local, section = 'pre_admission' AS pre FROM n),
      x AS (SELECT *, {_m(_r(500), _PRESENT)} AND section = 'present_illness' AS present, {_m('local', _HIST)} AS explicit FROM c)
      SELECT doc_id, s AS start, e AS "end", type, first AS case_start, ok AND {_scope} <> '' AND NOT {_m(_scope, '^(?:khong dien hinh|khong dac hieu|khong the|khong ro|khong co cai thien|khong lien quan)')} AND NOT {_m(_scope, r'\b(?:nhung|tuy nhien|song|however|but)\b')} AS negated,
        ok AND (role = 'family_history' OR {_m('right(line, 180)', _KIN)} OR {_m(_r(180), _KIN)}) AS family,
        ok AND CASE WHEN role IN ('medical_history', 'personal_history', 'family_history', 'epidemiology_history') THEN true
          WHEN type = '{DRUG}' THEN CASE WHEN {_m('local', _NEW_DRUG)} OR {_m(_r(180), _NEW_DRUG)} THEN false WHEN {_m('local', _OLD_DRUG)} THEN true WHEN pre THEN {_m('recent', _OLD_DRUG)} OR contains({_r(240)}, 'thuoc') ELSE {_m(_r(450), _OLD_PART)} END
          WHEN present AND type = '{SYMPTOM}' THEN explicit WHEN explicit THEN true WHEN present THEN false WHEN pre AND type = '{DIAGNOSIS}' THEN true
          WHEN pre AND type = '{SYMPTOM}' THEN {_m(_r(350), _HIST)} OR {_m(_r(350), r'\b(?:tap kinh|cac con).*(?:truoc day|vai nam)\b')} ELSE type = '{DIAGNOSIS}' AND {_m(_r(450), _OLD_PART)} END AS historical FROM x""",
    "ruled_drops": f"""WITH w AS (SELECT concept_id, type, {_K('text[s + 1:e]')} AS mention, {_K('text[greatest(0, s - 35) + 1:s]')} AS before, {_K('text[e + 1:e + 12]')} AS after, {_K("string_split(text[1:s], chr(10))[-1]")} AS prefix, {_K("string_split(text[1:s], chr(10))[-1] || text[s + 1:e] || string_split(text[e + 1:], chr(10))[1]")} AS line, {_K('text[greatest(0, s - 260) + 1:e + 300]')} AS wide FROM {NOTE}),
      r AS (SELECT concept_id, CASE WHEN type IN ('{DRUG}', '{SYMPTOM}') AND {_m('mention', '^.{0,3}$')} THEN 'short' WHEN type = '{SYMPTOM}' AND {_m('before', 'khong( co)?$')} AND {_m('line', '^- ')} THEN 'denied' WHEN contains(wide, 'gia dinh') AND NOT {_m('mention', '[0-9]')} AND NOT contains(prefix, 'benh nhan') THEN 'said of a family' WHEN type = '{DIAGNOSIS}' AND {_m('after', '^(man|cap)')} THEN 'goes on' END AS rule FROM w)
      SELECT concept_id, rule FROM r WHERE rule IS NOT NULL""",
    "out_of_order": "WITH r AS (SELECT doc_id, idx, min(struct_pack(s := char_position[1], e := char_position[2], t := concept_type)) AS x FROM concepts_mirror WHERE len(char_position) = 2 GROUP BY 1, 2), i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -idx ELSE idx END AS idx, x FROM r) SELECT doc_id, idx FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM i) WHERE b > x",
    "concept_problems": f"""WITH r AS (SELECT DISTINCT n.concept_id, CASE WHEN concept_id % 11 = 1 THEN '?' ELSE n.type END AS type, CASE WHEN concept_id % 11 = 3 THEN -1 ELSE n.s END AS s, CASE WHEN concept_id % 11 = 2 THEN n.e + 1000000 ELSE n.e END AS e, length(n.text) AS len_note, n.text[n.s + 1:n.e] AS there, CASE WHEN concept_id % 11 = 0 THEN NULL WHEN concept_id % 11 = 6 THEN c.text || '!' ELSE c.text END AS text,
        CASE WHEN concept_id % 11 = 4 THEN ['isNegated'] WHEN concept_id % 11 = 7 THEN ['odd'] ELSE c.assertions END AS assertions, CASE WHEN concept_id % 11 = 5 THEN ['X'] ELSE c.candidates END AS candidates FROM {NOTE} n JOIN concepts c USING (concept_id))
      SELECT DISTINCT concept_id, unnest(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'empty text' END, CASE WHEN type NOT IN ('{DIAGNOSIS}', '{DRUG}', '{SYMPTOM}', '{TEST_NAME}', '{TEST_RESULT}') THEN 'unknown type' END, CASE WHEN s < 0 OR e <= s OR e > len_note THEN 'bad position' END, CASE WHEN there <> text THEN 'text differs' END, CASE WHEN len(coalesce(assertions, [])) > 0 AND type NOT IN ('{SYMPTOM}', '{DIAGNOSIS}', '{DRUG}') THEN 'flags not allowed' END, CASE WHEN len(list_filter(coalesce(assertions, []), lambda x: x NOT IN ('isNegated', 'isFamily', 'isHistorical'))) > 0 THEN 'unknown flag' END, CASE WHEN len(coalesce(candidates, [])) > 0 AND type NOT IN ('{DIAGNOSIS}', '{DRUG}') THEN 'codes not allowed' END], lambda x: x IS NOT NULL)) AS problem FROM r""",
}
