"""Emission policy and refinement of concepts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontospan.config import ASSERTED, CODED, DIAGNOSIS, DRUG, FLAGS, SYMPTOM, TEST_NAME, TEST_RESULT
from ontospan.functions.text import line_after, line_before, normalize_key, window


def rules(raw: DataFrame) -> DataFrame:
    """Valid policy rows, the last of equal keys: (concept_type, alias_norm, profile, assertions, candidates). Null assertions are a wildcard."""
    clean = raw.select("concept_type", normalize_key(F.col("alias_norm")).alias("alias_norm"), "profile", F.array_sort(F.array_distinct("assertions")).alias("assertions"), "candidates", "rule_no")
    clean = clean.where(F.col("concept_type").isin(*CODED) & (F.col("alias_norm") != "") & F.col("profile").isin("short_line", "long_line"))
    return clean.groupBy("concept_type", "alias_norm", "profile", "assertions").agg(F.max_by("candidates", "rule_no").alias("candidates"))


def applied(concepts: DataFrame, policy: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """concepts (concept_type, alias_norm, profile, assertions, candidates) with `emitted`: the candidates of the rule for exactly
    these assertions, else of the wildcard rule, else of the curated profile, else their own. An empty rule or profile abstains.

    profiles (concept_type, alias_norm, profile, codes) are curated for a kind of line; each key once."""
    key = ["concept_type", "alias_norm", "profile"]
    exact = policy.where(F.col("assertions").isNotNull()).select(*key, F.col("assertions").alias("flags"), F.col("candidates").alias("exact_codes"))
    wild = policy.where(F.col("assertions").isNull()).select(*key, F.col("candidates").alias("wild_codes"))
    flags = F.array_sort(F.array_distinct(F.coalesce("assertions", F.array().cast("array<string>"))))
    out = concepts.withColumn("flags", flags).join(exact, [*key, "flags"], "left").join(wild, key, "left")
    base = [F.col("candidates")]
    if profiles is not None:
        out = out.join(profiles.select(*key, F.col("codes").alias("profile_codes")), key, "left")
        base = [F.col("profile_codes"), *base]
    return out.withColumn("emitted", F.coalesce("exact_codes", "wild_codes", *base)).drop("flags", "exact_codes", "wild_codes", "profile_codes")


def repaired(concepts: DataFrame, found: DataFrame) -> DataFrame:
    """concepts (type, text, candidates) whose candidates are empty, though the type is coded, with the code that is found for
    them (type, text, code); whatever a policy said of them before. Null candidates are empty here."""
    out = concepts.join(found.select("type", "text", F.col("code").alias("_code")).distinct(), ["type", "text"], "left")
    none = F.col("type").isin(*CODED) & (F.size(F.coalesce("candidates", F.array().cast("array<string>"))) == 0)
    return out.withColumn("candidates", F.when(none & F.col("_code").isNotNull(), F.array("_code")).otherwise(F.col("candidates"))).drop("_code")


def out_of_order(concepts: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, idx) of the concepts that don't come after the one before them by start, end and type."""
    at = F.struct("start", "end", "type")
    return concepts.withColumn("_before", F.lag(at).over(W.partitionBy(group).orderBy("idx"))).where(F.col("_before") > at).select(group, "idx")


@dataclass(frozen=True)
class Rule:
    """A row of a rule table. It holds for a concept if its type is one of `kinds` (any, if there are none), every pattern of
    `where` is found in the field of that name and no pattern of `unless` is; `result` is what then comes out."""

    result: str
    kinds: tuple[str, ...] = ()
    where: dict[str, str] = field(default_factory=dict)
    unless: dict[str, str] = field(default_factory=dict)


def first_result(rules: Sequence[Rule], kind: Column, fields: dict[str, Column]) -> Column:
    """The result of the first rule that holds, null where none does. A null field is like an empty one."""
    found = lambda name, pattern: F.coalesce(fields[name], F.lit("")).rlike(pattern)

    def holds(rule: Rule) -> Column:
        tests = [kind.isin(*rule.kinds)] if rule.kinds else []
        tests += [found(*x) for x in rule.where.items()] + [~found(*x) for x in rule.unless.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return F.coalesce(*(F.when(holds(r), F.lit(r.result)) for r in rules), F.lit(None).cast("string"))


def looked_at(*tables: Sequence[Rule]) -> set[str]:
    """The names of the fields that rules look at."""
    return {name for rules in tables for r in rules for name in (*r.where, *r.unless)}


def around(text: Column, start: Column, end: Column) -> dict[str, Column]:
    """The fields that rules about a concept may look at, as keys: the mention, what is near before and after it, its line, the
    line before it, and a wide window."""
    key = lambda c: normalize_key(c)
    return {
        "mention": key(F.substring(text, start + 1, end - start)),
        "before": key(F.substring(text, F.greatest(F.lit(0), start - 35) + 1, F.least(F.lit(35), start))),
        "after": key(F.substring(text, end + 1, F.lit(12))),
        "prefix": key(line_before(text, start)),
        "line": key(F.concat(line_before(text, start), F.substring(text, start + 1, end - start), line_after(text, end))),
        "wide": key(window(text, start, end, 260, 300)),
    }


def repaired_flags(kind: Column, assertions: Column) -> Column:
    """The allowed flags in their order; none for types without flags."""
    return F.when(kind.isin(*ASSERTED), F.array_intersect(F.array(*(F.lit(f) for f in FLAGS)), F.coalesce(assertions, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))


def problems(kind: Column, text: Column, start: Column, end: Column, there: Column, n_chars: Column, assertions: Column, candidates: Column) -> Column:
    """Array of what is wrong with a concept; empty if nothing is. there: what the source has at its place; n_chars: its length."""
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    tests = [
        (F.coalesce(text, F.lit("")) == "", "empty text"),
        (~F.coalesce(kind.isin(DIAGNOSIS, DRUG, SYMPTOM, TEST_NAME, TEST_RESULT), F.lit(False)), "unknown type"),
        (start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end > n_chars), "bad position"),
        (there != text, "text differs"),
        (some(assertions) & ~kind.isin(*ASSERTED), "flags not allowed"),
        (some(F.array_except(F.coalesce(assertions, F.array().cast("array<string>")), F.array(*(F.lit(f) for f in FLAGS)))), "unknown flag"),
        (some(candidates) & ~kind.isin(*CODED), "codes not allowed"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in tests)), lambda x: x.isNotNull())
