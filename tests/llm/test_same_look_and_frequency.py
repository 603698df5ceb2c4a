"""Problems 1 and 2."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ontospan.llm import frequency, same_look

ROWS = "row_id long, raw string, form string, term_id long"


def found(spark, rows, terms):
    left = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], ROWS)
    right = spark.createDataFrame(terms, "term_id long, term string")
    return sorted(map(tuple, same_look.written_otherwise(left, "row_id", "raw", right, "term_id", "term").collect()))


def test_looks_the_same_in_other_characters(spark):
    terms = [(1, "đau bụng"), (2, "m2"), (3, "Đau bụng"), (4, "α-GT"), (None, "x"), (5, None)]
    rows = [(1, "đau bụng"), (2, "\u0111au b\u0075\u0323ng"), (3, "đau\u00a0bụng"), (4, "ｍ2"), (5, "m²"), (6, "Ðau bụng"), (7, "α‐GT"), (8, None), (9, ""), (None, "ｍ2"), (4, "ｍ2"), (10, "dau bung"), (11, "\u200b" * 50_000 + "m2")]
    assert found(spark, rows, terms) == [(2, 1), (3, 1), (4, 2), (6, 3), (7, 4), (11, 2)]


def test_empty_tables_and_terms(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "ａ")], []) == []


COLUMNS = "concept_type string, term_value string, doc_id long, concept_id long, text string, n_docs int, mark string"


def test_counts_by_brute_force_with_a_hot_term(spark):
    rng = random.Random(4)
    rows = [(rng.choice("AB"), "hot" if rng.random() < 0.4 else f"t{rng.randint(0, 60)}", rng.choice([None, *range(80)]), i, "x", 7, "clash") for i in range(3000)]
    rows += rng.sample(rows, 300)  # delivered again
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.concept_type, r.term_value): (r.n_rows, r.n_docs) for r in frequency.term_counts(df, ["concept_type", "term_value"], "doc_id", "concept_id", "text").collect()}
    n, d = defaultdict(set), defaultdict(set)
    for t, v, doc, i, *_ in rows:
        n[t, v].add((doc, i))
        d[t, v] |= {doc} - {None}
    assert got == {k: (len(n[k]), len(d[k])) for k in n}


def test_marks(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 5), ("e", 4)], "term_value string, n_docs long")
    marks = {r.term_value: r.mark for r in frequency.marked(df, 100).collect()}
    assert marks == {"a": None, "b": "rare", "c": None, "d": "common", "e": None}


def test_null_terms_and_no_rows(spark):
    df = spark.createDataFrame([(None, "v", 1, 1, None, 0, ""), (None, "v", 1, 1, None, 0, "")], COLUMNS)
    assert [(r.n_rows, r.n_docs) for r in frequency.term_counts(df, ["concept_type", "term_value"], "doc_id", "concept_id", "text").collect()] == [(1, 1)]
    assert frequency.term_counts(df.where(F.lit(False)), ["concept_type", "term_value"], "doc_id", "concept_id", "text").count() == 0
