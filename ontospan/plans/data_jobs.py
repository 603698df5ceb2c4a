"""Queries of the general data jobs: differences between copies and changes between snapshots."""

from ontospan.operators import copies, snapshots
from ontospan.plans.sql import form

QUERIES = {"p3_found": copies.p3_found, "p3_cells": copies.p3_cells, "p6_found": snapshots.p6_found, "p6_summary": snapshots.p6_summary}

_state = lambda table, version, extra="": f"(SELECT *, {form('concept_type')} AS t, list_sort(list_distinct(assertions)) AS flags FROM {table} WHERE concept_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY {version} DESC NULLS LAST) = 1)"
_CHANGES = f"""WITH s AS (SELECT *, {form('text')} AS f FROM concept_snapshots QUALIFY row_number() OVER (PARTITION BY snapshot_no, concept_id ORDER BY loaded_at DESC NULLS LAST) = 1)
  SELECT coalesce(n.snapshot_no, o.snapshot_no + 1) AS snapshot_no, coalesce(n.concept_id, o.concept_id) AS concept_id, CASE WHEN o.concept_id IS NULL THEN 'added' WHEN n.concept_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM s o FULL JOIN s n ON o.concept_id = n.concept_id AND n.snapshot_no = o.snapshot_no + 1
  WHERE coalesce(n.snapshot_no, o.snapshot_no + 1) BETWEEN (SELECT min(snapshot_no) + 1 FROM s) AND (SELECT max(snapshot_no) FROM s)
    AND (o.concept_id IS NULL OR n.concept_id IS NULL OR o.f IS DISTINCT FROM n.f OR o.char_position IS DISTINCT FROM n.char_position OR o.candidates IS DISTINCT FROM n.candidates)"""
SQL = {
    "p3_found": f"""WITH l AS {_state('concepts', 'received_at')}, r AS {_state('concepts_mirror', 'synced_at')},
      b AS (SELECT coalesce(l.concept_id, r.concept_id) AS concept_id, CASE WHEN r.concept_id IS NULL THEN ['only_in_concepts'] WHEN l.concept_id IS NULL THEN ['only_in_mirror'] ELSE list_filter([CASE WHEN l.t IS DISTINCT FROM r.t THEN 'concept_type' END, CASE WHEN l.char_position IS DISTINCT FROM r.char_position THEN 'char_position' END, CASE WHEN l.flags IS DISTINCT FROM r.flags THEN 'assertions' END, CASE WHEN l.candidates IS DISTINCT FROM r.candidates THEN 'candidates' END], lambda x: x IS NOT NULL) END AS d FROM l FULL JOIN r ON l.concept_id = r.concept_id)
      SELECT concept_id, unnest(d) AS difference FROM b""",
    "p6_found": _CHANGES,
    "p6_summary": f"SELECT snapshot_no, change_kind, count(*) AS n FROM ({_CHANGES}) GROUP BY 1, 2",
}
