"""SQL of structural roles and blocks, with its own headings."""

from __future__ import annotations

from ontospan.plans import sql
from ontospan.plans.text_queries import LINES

_K = sql.key
_heads = lambda c, names: f"regexp_matches({c}, '^(?:{names})(?:$|[ :])')"
_QUESTION, _ANSWER = "cau hoi|cau hoi tu nguoi dung|cau hoi cua nguoi dung|question", "cau tra loi|cau tra loi cua bac si|bac si tra loi|dap"
_PRE, _NOW = "tien su benh|lich su benh|past medical history|pmh", "tien su benh hien tai|benh su hien tai|lich su benh hien tai|benh su|history of present illness"
_HOSPITAL = "danh gia tai benh vien|kham tai benh vien|kham tai vien|luc vao vien|assessment"
_EVENTS = "cac su kien truoc khi nhap vien|su kien truoc khi nhap vien|cac dien bien truoc khi nhap vien|dien bien truoc khi nhap vien"
_SYMPTOMS = "dac diem cua trieu chung|dac diem trieu chung|trieu chung khi nhap vien|trieu chung hien tai|cac trieu chung lien quan|thoi diem khoi phat trieu chung|vi tri"
_LABS = "can lam sang|xet nghiem|xn luc vao vien|ket qua xet nghiem|ket qua laboratory|ket qua phong thi nghiem|ket qua chan doan hinh anh|chan doan hinh anh va tham do|dien tam do|men tim|sieu am tim"
_DIAGNOSES, _TREATMENTS = "chan doan|cac chan doan", "dieu tri|don thuoc|thuoc dieu tri|xu tri thuoc"
_ARTICLE = "la gi|dau hieu|trieu chung|nguyen nhan|bien chung|co nguy hiem|can lam gi|phong ngua|dieu tri|chan doan"
_ADVICE = "du hien tai|de theo doi tai nha|ban nen|em nen|gia dinh hay"
_title = "regexp_extract(key, '^([0-9]+)[.]* (.*)$', 2)"
_number = "regexp_extract(key, '^([0-9]+)[.]* (.*)$', 1)"
_like = "(length(key) <= 140 AND (regexp_matches(line, '^\\s*[0-9]+(?:[.][0-9]+)*[.)/]?\\s+') OR regexp_matches(rtrim(line, ' '), '[:：]$') OR len(string_split(key, ' ')) <= 12 AND NOT regexp_matches(rtrim(line, ' '), '[.?!]$')))"
_person = "^(?:[0-9]+(?:[.][0-9]+)*[.)/]?\\s*)?(?:benh nhan|bn)\\s+(?:nam|nu)"
_ROLE = f"""CASE WHEN regexp_matches(low, '^(?:hỏi|hoi|question)\\s*[:：-]') OR {_heads('key', _QUESTION)} THEN 'question' WHEN regexp_matches(low, '^(?:trả lời|tra loi|đáp|dap|answer)\\s*[:：-]') OR {_heads('key', _ANSWER)} THEN 'answer'
  WHEN {_number} = '1' AND {_heads(_title, _PRE)} THEN 'medical_history' WHEN {_number} = '2' AND {_heads(_title, _NOW)} THEN 'present_illness' WHEN {_number} = '3' AND {_heads(_title, _HOSPITAL)} THEN 'hospital_evaluation'
  WHEN regexp_matches(key, '{_person}\\s+[0-9]+\\s+tuoi\\b') OR regexp_matches(key, '{_person}\\b') AND contains(left(key, 180), 'vao vien') THEN 'patient_case'
  WHEN {_heads('h', 'tien su ban than')} THEN 'personal_history' WHEN {_heads('h', 'tien su gia dinh')} THEN 'family_history' WHEN {_heads('h', 'tien su dich te')} THEN 'epidemiology_history' WHEN {_heads('h', _EVENTS)} THEN 'pre_admission_events' WHEN {_heads('h', _SYMPTOMS)} THEN 'symptom_profile'
  WHEN {_like} AND {_heads('h', _LABS)} THEN 'lab_or_imaging' WHEN {_like} AND {_heads('h', _DIAGNOSES)} THEN 'diagnosis' WHEN {_like} AND {_heads('h', _TREATMENTS)} THEN 'treatment'
  WHEN length(h) <= 150 AND regexp_matches(h, '{_ARTICLE}') AND NOT regexp_matches(line, '^\\s*[-*•]') AND (regexp_matches(line, '^\\s*[0-9]+(?:[.][0-9]+)*[.)]?\\s+') OR len(string_split(h, ' ')) <= 14 AND NOT regexp_matches(rtrim(line, ' '), '[.]$')) THEN 'medical_article' END"""
_KEYED = f"(SELECT *, regexp_replace(key, '^[0-9]+(?:[.][0-9]+)*[.)/]?\\s*', '') AS h, lower(regexp_replace(line, '^[\\s*\\-]+', '')) AS low FROM (SELECT doc_id, line, s + length(regexp_extract(line, '^[\\s:\\-*]*')) AS start, {_K('''regexp_extract(line, '^[\\s:\\-*]*(.*?)[\\s:\\-*]*$', 1)''')} AS key FROM {LINES}) WHERE key <> '')"
_HITS = f"""(SELECT doc_id, start, CASE WHEN back AND NOT coalesce(max(back) OVER (PARTITION BY doc_id, island, role ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'answer' ELSE role END AS role FROM (
  SELECT *, coalesce(advice AND asked AND active NOT IN ('question', 'answer'), false) AS back FROM (
  SELECT *, coalesce(max(coalesce(role = 'question', false)) OVER b, false) AS asked, last_value(role IGNORE NULLS) OVER b AS active, count(role) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM (
  SELECT doc_id, start, {_ROLE} AS role, {_heads('key', _ADVICE)} OR regexp_matches(' ' || key || ' ', ' (?:em|ban) nen ') AS advice FROM {_KEYED}) WHERE role IS NOT NULL OR advice
  WINDOW b AS (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))"""
_TITLES = "|".join([_PRE, _NOW, _HOSPITAL, "tien su ban than|tien su gia dinh|tien su dich te", _LABS, _DIAGNOSES, _TREATMENTS, _SYMPTOMS, _EVENTS])


def blocks(sections: str) -> str:
    """Blocks of notes that have no second case, from the SQL of their sections."""
    value = "regexp_replace(text[start + 1:stop], '^\\s+|\\s+$', '', 'g')"
    key = f"regexp_replace(regexp_replace({_K('''regexp_replace(v, '^[*\\- ]+|[*\\- ]+$', '', 'g')''')}, '^[0-9]+(?:[.][0-9]+)*[.)/]?\\s*', ''), ':+$', '')"
    return f"""WITH a AS (SELECT doc_id, start, CASE name WHEN 'pre_admission' THEN 'medical_history' WHEN 'present_illness' THEN 'present_illness' WHEN 'hospital_evaluation' THEN 'hospital_evaluation' ELSE 'document' END AS role, 0 AS rank FROM ({sections}) UNION ALL SELECT doc_id, start, role, 1 FROM {_HITS} WHERE role IS NOT NULL),
      h AS (SELECT doc_id, start, arg_max(role, rank) AS role FROM a GROUP BY 1, 2),
      k AS (SELECT * FROM (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM h) WHERE before IS NULL OR before <> role OR role IN ('question', 'answer', 'medical_article', 'patient_case', 'personal_history', 'family_history', 'epidemiology_history')),
      b AS (SELECT k.doc_id, role, start, coalesce(lead(start) OVER (PARTITION BY k.doc_id ORDER BY start), length(text)) AS stop, text FROM k JOIN documents d ON d.doc_id = k.doc_id),
      v AS (SELECT doc_id, role, start, stop, {value} AS v FROM b), n AS (SELECT *, role NOT IN ('question', 'answer', 'patient_case') AND length(v) <= 160 AND NOT contains(v, chr(10)) AND trim({key}) IN ({', '.join(f"'{t}'" for t in _TITLES.split('|'))}) AS bare FROM v),
      i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - row_number() OVER (PARTITION BY doc_id, bare ORDER BY start) AS island, lead(stop) OVER (PARTITION BY doc_id ORDER BY start) AS next_stop, lead(role) OVER (PARTITION BY doc_id ORDER BY start) AS next_role FROM n),
      j AS (SELECT *, bare AND row_number() OVER (PARTITION BY doc_id, bare, island ORDER BY start) % 2 = 1 AND next_stop IS NOT NULL AS joins FROM i),
      x AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY start), false) AS absorbed FROM j)
      SELECT doc_id, CASE WHEN joins THEN next_role ELSE role END AS role, start, CASE WHEN joins THEN next_stop ELSE stop END AS "end", 1 AS case_no FROM x WHERE NOT absorbed"""


SQL = {"note_roles": f"SELECT doc_id, start, role FROM {_HITS} WHERE role IS NOT NULL"}
