"""The SQL that problem 9's queries are compared with."""

from ontospan.llm.truncation import ALPHABET

_quoted = lambda x: x.replace("'", "''")


def _tokens(c: str) -> str:
    x = f"regexp_replace(replace({c}, '¶', ' '), '(?m)^[ \\t]*[-+*•][ \\t]+([^\\r\\n]*)', '\\1 ¶', 'g')"
    x = f"replace(regexp_replace({x}, '[.]{{3,}}|…', ' ', 'g'), 'ß', 'ss')"
    x = f"lower(translate({x}, '{_quoted(ALPHABET[0])}', '{_quoted(ALPHABET[1])}'))"
    x = f"regexp_replace({x}, '[0-9]+([.,][0-9]+)*', '0', 'g')"
    x = f"regexp_replace({x}, ' *\\n[ \\n]*', ' ' || chr(10) || ' ', 'g')"
    return f"string_split_regex(trim(regexp_replace({x}, '([.,])[.,]*( |$)', ' \\1 ', 'g')), ' +')"


# a trigram's context is written as text here; the last level with two occurrences or more decides
_ENDS = f"""
WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
l AS (SELECT doc_id, source, list_filter(string_split_regex(text, '[\\r\\n]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))[-1] AS line FROM d),
f0 AS (SELECT doc_id, source, {_tokens('line')} AS a FROM l WHERE line IS NOT NULL),
f AS (SELECT doc_id, source, a[-1] = '¶' AS in_list, CASE WHEN a[-1] = '¶' THEN a[:-2] ELSE a END AS a FROM f0),
g AS (SELECT *, a[-1] = '.' AS stopped, CASE WHEN a[-1] = '.' OR a[-1] = ',' AND in_list THEN a[:-2] ELSE a END AS b FROM f),
e AS (SELECT doc_id, source, in_list, stopped, coalesce(b[-1], chr(10)) AS w, coalesce(b[-2], chr(10)) AS y, CASE WHEN coalesce(b[-2], chr(10)) = chr(10) THEN chr(10) ELSE coalesce(b[-3], chr(10)) END AS x FROM g),
t AS (SELECT {_tokens('text')} AS a FROM (SELECT DISTINCT text FROM d)),
o AS (SELECT CASE WHEN i < 2 OR a[i - 1] = chr(10) OR i < 3 THEN chr(10) ELSE a[i - 2] END AS x, CASE WHEN i < 2 THEN chr(10) ELSE a[i - 1] END AS y, a[i] AS w, a[i + 1] AS z FROM t, unnest(range(1, len(a) + 1)) AS r(i)),
c AS (SELECT x, y, w, count(*) FILTER (z IS NOT NULL AND z NOT IN (chr(10), '¶')) AS goes, count(*) FILTER (z IS NULL OR z = chr(10)) AS done, count(*) FILTER (z = '¶') AS items FROM o WHERE w NOT IN ('.', '¶', chr(10), '') GROUP BY ALL),
k AS (SELECT DISTINCT x, y, w, in_list FROM e WHERE NOT stopped),
v3 AS (SELECT k.x, k.y, k.w, k.in_list, coalesce(sum(c.goes + c.done + c.items) FILTER (c.w <> k.w), 0) AS longer, coalesce(sum(c.goes) FILTER (c.w = k.w), 0) AS goes, coalesce(sum(c.done) FILTER (c.w = k.w), 0) AS done, coalesce(sum(c.items) FILTER (c.w = k.w), 0) AS items
       FROM k LEFT JOIN c ON c.x = k.x AND c.y = k.y AND starts_with(c.w, k.w) GROUP BY ALL),
c2 AS (SELECT y, w, sum(goes) AS goes, sum(done) AS done, sum(items) AS items FROM c GROUP BY ALL),
v2 AS (SELECT k.y, k.w, k.in_list, coalesce(sum(c.goes + c.done + c.items) FILTER (c.w <> k.w), 0) AS longer, coalesce(sum(c.goes) FILTER (c.w = k.w), 0) AS goes, coalesce(sum(c.done) FILTER (c.w = k.w), 0) AS done, coalesce(sum(c.items) FILTER (c.w = k.w), 0) AS items
       FROM (SELECT DISTINCT y, w, in_list FROM k) k LEFT JOIN c2 c ON c.y = k.y AND starts_with(c.w, k.w) GROUP BY ALL),
n AS (SELECT v3.x, v3.y, v3.w, in_list, v3.longer + CASE WHEN in_list THEN 0 ELSE v3.goes END AS on3, greatest(v3.done + CASE WHEN in_list THEN v3.goes + v3.items ELSE 0 END - 1, 0) AS end3,
             v2.longer + CASE WHEN in_list THEN 0 ELSE v2.goes END AS on2, greatest(v2.done + CASE WHEN in_list THEN v2.goes + v2.items ELSE 0 END - 1, 0) AS end2
      FROM v3 JOIN v2 USING (y, w, in_list)),
r AS (SELECT *, CASE WHEN on3 + end3 >= 2 THEN on3 >= 2 AND end3 <= 0.2 * (on3 + end3) WHEN on2 + end2 >= 2 THEN on2 >= 2 AND end2 <= 0.2 * (on2 + end2) END AS cut FROM n)
SELECT doc_id, source, CASE WHEN stopped THEN false ELSE r.cut END AS truncated FROM e LEFT JOIN r USING (x, y, w, in_list)
"""
SQL = {
    "p9_found": f"SELECT DISTINCT doc_id FROM ({_ENDS}) WHERE truncated",
    "p9_rates": f"SELECT regexp_replace(lower(trim(source)), '[\\s\\-_]+', '_', 'g') AS source, count(*) AS n_documents, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (truncated IS NULL) AS n_unknown, round(coalesce(avg(CAST(truncated AS INT)), 0), 6) AS rate FROM ({_ENDS}) GROUP BY 1",
}
