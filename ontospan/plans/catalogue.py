"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from ontospan.plans import code_queries, data_jobs, eval_queries, note_queries, pipeline, text_queries

PARTS = [data_jobs, text_queries, note_queries, code_queries, eval_queries, pipeline]


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
