"""Span reconciliation: overlap resolution, merge, structural gate, relations, nested and duplicate spans.

Greedy choices need overlapping spans of one document together and nothing else, so they are one aggregation by stretch and a
fold over a sorted array. Range joins carry the document id as an equality, which makes them hash or merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG, SYMPTOM, TEST_NAME, TEST_RESULT

# Which type wins where spans are otherwise equal.
TYPE_RANK = {DRUG: 0, DIAGNOSIS: 1, TEST_RESULT: 2, TEST_NAME: 3, SYMPTOM: 4}


def type_rank(c: Column, ranks: dict[str, int] | None = None) -> Column:
    ranks = ranks or TYPE_RANK
    out = F.lit(len(ranks))
    for name, rank in ranks.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def greedy(spans: DataFrame, group: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The spans kept when each is taken, in the given order, unless it overlaps one taken before: (group, columns).

    spans needs start and end; order must be total. Empty and reversed spans are never taken. Documents whose spans are all
    dropped give no rows. A document is cut where no span reaches across, so that the fold sees few spans at a time.
    """
    item = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *(F.col(c) for c in columns))
    by_start = W.partitionBy(group).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.where(F.col("start") < F.col("end")).withColumn("_gap", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    rows = rows.withColumn("_stretch", F.sum("_gap").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    per_stretch = rows.groupBy(group, "_stretch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    taken = F.aggregate("items", F.filter("items", lambda x: F.lit(False)), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return per_stretch.select(group, F.explode(taken).alias("x")).select(group, *(F.col(f"x.{c}").alias(c) for c in columns))


def resolve_overlaps(spans: DataFrame, group: str = "doc_id") -> DataFrame:
    """Rule proposals without overlaps: longest, then type, score and start decide."""
    order = [F.col("start") - F.col("end"), type_rank(F.col("type")), -F.col("score"), F.col("start"), F.col("type")]
    return greedy(spans, group, order, ["start", "end", "type", "score"])


def merge_proposals(spans: DataFrame, group: str = "doc_id") -> DataFrame:
    """Spans of two proposers (source `rule` or `llm`) merged: rules first, by score, then longer rules or shorter others.

    Exact duplicates are one span.
    """
    length = F.col("end") - F.col("start")
    order = [(F.col("source") != "rule").cast("int"), -F.col("score"), F.when(F.col("source") == "rule", -length).otherwise(length), type_rank(F.col("type")), F.col("start"), F.col("end"), F.col("type")]
    return greedy(spans, group, order, ["start", "end", "type", "score", "source"])


def merge_summary(spans: DataFrame, kept: DataFrame, group: str = "doc_id") -> DataFrame:
    """Per document its proposals, the invalid ones, exact duplicates, kept and dropped for overlap."""
    counts = spans.groupBy(group, "start", "end", "type").agg(F.count("*").alias("n")).groupBy(group).agg(
        F.sum("n").alias("n_spans"),
        F.coalesce(F.sum(F.when(F.col("start") >= F.col("end"), F.col("n"))), F.lit(0)).alias("n_invalid"),
        F.coalesce(F.sum(F.when(F.col("start") < F.col("end"), F.col("n") - 1)), F.lit(0)).alias("n_duplicate"),
    )
    n_kept = kept.groupBy(group).agg(F.count("*").alias("n_kept"))
    out = counts.join(n_kept, group, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return out.withColumn("n_overlap", F.col("n_spans") - F.col("n_invalid") - F.col("n_duplicate") - F.col("n_kept"))


def smallest_containing(spans: DataFrame, chunks: DataFrame, group: str = "doc_id") -> DataFrame:
    """spans with the structure_role of the smallest chunk around them, the earliest of equal ones; null where none is."""
    keys = [group, "start", "end", "type"]
    inside = spans.alias("s").join(chunks.alias("c"), (F.col(f"s.{group}") == F.col(f"c.{group}")) & (F.col("c.start_pos") <= F.col("s.start")) & (F.col("s.end") <= F.col("c.end_pos")), "left")
    role = F.min_by("c.structure_role", F.when(F.col("c.start_pos").isNotNull(), F.struct(F.col("c.end_pos") - F.col("c.start_pos"), F.col("c.start_pos"), F.col("c.structure_role"))))
    return inside.groupBy(*(F.col(f"s.{k}").alias(k) for k in keys)).agg(F.max("s.score").alias("score"), role.alias("structure_role"))


def gate(rules: DataFrame, chunks: DataFrame, confirmed: DataFrame, unconfirmed_roles: list[str], high: float = 0.95, group: str = "doc_id") -> DataFrame:
    """Rule spans that may stay: outside chunks of the given roles, or above the high score and not in an answer, or confirmed by
    the other proposer with the same place and type. Spans in no chunk stay."""
    placed = smallest_containing(rules, chunks, group)
    keys = [group, "start", "end", "type"]
    seen = confirmed.select(*keys).distinct().withColumn("confirmed", F.lit(True))
    needs = F.coalesce(F.col("structure_role").isin(unconfirmed_roles), F.lit(False))
    sure = (F.col("score") > high) & (F.col("structure_role") != "answer")
    return placed.join(seen, keys, "left").where(~needs | sure | F.col("confirmed")).select(*keys, "score", "structure_role")


def near_pairs(left: DataFrame, right: DataFrame, distance: int, group: str = "doc_id") -> DataFrame:
    """(group, a, b): structs of all pairs of one group whose starts are at most `distance` apart. They meet by stretches of that
    length, so that a long document isn't joined with all of itself."""
    size = distance + 1
    a = left.select(group, F.struct(*left.columns).alias("a"), F.explode(F.array(*(F.floor(F.col("start") / size) + d for d in (-1, 0, 1)))).alias("stretch"))
    b = right.select(group, F.struct(*right.columns).alias("b"), F.floor(F.col("start") / size).alias("stretch"))
    return a.join(b, [group, "stretch"]).where(F.abs(F.col("a.start") - F.col("b.start")) <= distance).drop("stretch")


def relations(spans: DataFrame, distance: int = 120, group: str = "doc_id") -> DataFrame:
    """Ordered pairs of spans near each other: a drug with a symptom or condition, a test with a result."""
    rows = spans.select(group, "start", "type")
    pairs = near_pairs(rows.where(F.col("type").isin(DRUG, TEST_NAME)), rows.where(F.col("type").isin(SYMPTOM, DIAGNOSIS, TEST_RESULT)), distance, group)
    kind = F.when((F.col("a.type") == DRUG) & F.col("b.type").isin(SYMPTOM, DIAGNOSIS), "treats").when((F.col("a.type") == TEST_NAME) & (F.col("b.type") == TEST_RESULT), "has_result")
    return pairs.select(group, F.col("a.start").alias("source_start"), F.col("b.start").alias("target_start"), kind.alias("relation")).where(F.col("relation").isNotNull())


def drop_nested(spans: DataFrame, inner: str = DIAGNOSIS, outer: str = TEST_NAME, group: str = "doc_id") -> DataFrame:
    """Without spans of the inner type that lie within a longer span of the outer type."""
    a, b = spans.alias("a"), spans.where(F.col("type") == outer).select(group, F.col("start").alias("s"), F.col("end").alias("e")).distinct().alias("b")
    inside = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.type") == inner) & (F.col("b.s") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.e")) & (F.col("a.end") - F.col("a.start") < F.col("b.e") - F.col("b.s"))
    return a.join(b, inside, "left_anti")


def dedupe_best(spans: DataFrame, group: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One span per place and type: the one with most candidates, the first of equal ones by row id; with the columns to keep."""
    columns = ["row_id", "candidates", *(keep or [])]
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce(F.size("candidates"), F.lit(0)), -F.col("row_id"))).alias("x")
    return spans.groupBy(group, "start", "end", "type").agg(best).select(group, "start", "end", "type", *(F.col(f"x.{c}") for c in columns))
