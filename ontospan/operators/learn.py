"""Learning from labelled concepts: alias statistics, preferred code sets, emission rules, phrase lexicon, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontospan.functions.text import jaccard, normalize_key


def _sets(gold: DataFrame) -> DataFrame:
    codes = F.array_sort(F.array_distinct(F.coalesce("candidates", F.array().cast("array<string>"))))
    return gold.select("concept_type", normalize_key(F.col("text")).alias("alias_norm"), "file", codes.alias("codes")).where("alias_norm <> ''")


def alias_statistics(gold: DataFrame) -> DataFrame:
    """(concept_type, alias_norm, code, support, file_support, rank): how often, and in how many files, an alias has a code."""
    rows = _sets(gold).select("concept_type", "alias_norm", "file", F.explode("codes").alias("code"))
    counts = rows.groupBy("concept_type", "alias_norm", "code", "file").agg(F.count("*").alias("n")).groupBy("concept_type", "alias_norm", "code").agg(F.sum("n").alias("support"), F.count("*").alias("file_support"))
    order = W.partitionBy("concept_type", "alias_norm").orderBy(F.col("support").desc(), F.col("file_support").desc(), "code")
    return counts.withColumn("rank", F.row_number().over(order))


def set_distribution(gold: DataFrame) -> DataFrame:
    """(concept_type, alias_norm, codes, support): how often an alias has exactly these codes; the empty set too."""
    return _sets(gold).groupBy("concept_type", "alias_norm", "codes").agg(F.count("*").alias("support"))


def preferred_sets(distribution: DataFrame) -> DataFrame:
    """(concept_type, alias_norm, codes): the observed or empty set with the greatest expected weighted Jaccard; null if tied.

    All observed sets of an alias are compared with each other: the pairs, not the sets, are what is aggregated, by alias and
    choice, so that the sets of a hot alias are spread over tasks once they have met.
    """
    key = ["concept_type", "alias_norm"]
    choices = distribution.select(*key, F.col("codes").alias("choice")).unionByName(distribution.select(*key).distinct().select(*key, F.array().cast("array<string>").alias("choice"))).distinct()
    utility = choices.join(distribution, key).groupBy(*key, "choice").agg(F.round(F.sum(F.col("support") * (F.size("codes") + 1) * jaccard(F.col("codes"), F.col("choice"))), 6).alias("utility"))
    top = utility.groupBy(*key).agg(F.max("utility").alias("best"))
    return utility.join(top, key).where(F.col("utility") == F.col("best")).groupBy(*key).agg(F.when(F.count("*") == 1, F.first("choice")).alias("codes"), F.max("best").alias("utility"))


def empty_support(gold: DataFrame) -> DataFrame:
    """(concept_type, alias_norm, support, file_support, empty_support): how often an alias occurs, in how many files, and uncoded."""
    rows = _sets(gold).groupBy("concept_type", "alias_norm", "file").agg(F.count("*").alias("n"), F.count_if(F.size("codes") == 0).alias("none"))
    return rows.groupBy("concept_type", "alias_norm").agg(F.sum("n").alias("support"), F.count("*").alias("file_support"), F.sum("none").alias("empty_support"))


def dominant_codes(gold: DataFrame, least: int = 2, share: float = 0.67) -> DataFrame:
    """(concept_type, alias_norm, codes, share) of the code set, empty or not, that an alias has at least so often."""
    counts = set_distribution(gold)
    totals = counts.groupBy("concept_type", "alias_norm").agg(F.sum("support").alias("total"))
    return counts.join(totals, ["concept_type", "alias_norm"]).where((F.col("total") >= least) & (F.col("support") >= F.col("total") * share)).select("concept_type", "alias_norm", "codes", F.round(F.col("support") / F.col("total"), 6).alias("share"))


def learned_rules(items: DataFrame, least_files: int = 2, least_gain: float = 1.0) -> DataFrame:
    """Emission rules per type, alias, profile and assertions: the best fixed code set, where it gains enough over what was
    predicted in at least so many files. items: file, concept_type, alias_norm, profile, assertions, expected, predicted."""
    key = ["concept_type", "alias_norm", "profile", "flags"]
    empty = F.array().cast("array<string>")
    rows = items.select("file", "concept_type", "alias_norm", "profile", F.concat_ws("|", F.array_sort(F.array_distinct(F.coalesce("assertions", empty)))).alias("flags"), F.array_sort(F.array_distinct(F.coalesce("expected", empty))).alias("expected"), F.array_sort(F.array_distinct(F.coalesce("predicted", empty))).alias("predicted"))
    weight = F.size("expected") + 1
    per_set = rows.groupBy(*key, "expected").agg(F.count("*").alias("n"), F.sum(weight * jaccard(F.col("expected"), F.col("predicted"))).alias("now"))
    support = rows.groupBy(*key).agg(F.count("*").alias("support"), F.count_distinct("file").alias("file_support")).where(F.col("file_support") >= least_files)
    base = per_set.groupBy(*key).agg(F.sum("now").alias("baseline"))
    fixed = per_set.select(*key, F.col("expected").alias("codes")).unionByName(base.select(*key, empty.alias("codes"))).distinct()
    utility = fixed.join(per_set, key).groupBy(*key, "codes").agg(F.sum(F.col("n") * (F.size("expected") + 1) * jaccard(F.col("expected"), F.col("codes"))).alias("utility"))
    best = utility.groupBy(*key).agg(F.max_by("codes", F.struct(F.round("utility", 6), -F.size("codes"), F.concat_ws("|", "codes"))).alias("codes"), F.max("utility").alias("utility"))
    return best.join(base, key).join(support, key).withColumn("gain", F.round(F.col("utility") - F.col("baseline"), 6)).where(F.col("gain") >= least_gain).select(*key, "codes", "support", "file_support", "gain")


def phrase_lexicon(gold: DataFrame, least: int = 10, stop: list[str] | None = None, single: list[str] | None = None) -> DataFrame:
    """(concept_type, alias_norm, term, frequency) of phrases of at least two words, and of the single words allowed, with so many
    occurrences, in their first surface form; without the stop phrases."""
    rows = gold.select("concept_type", normalize_key(F.col("text")).alias("alias_norm"), "text", "concept_id")
    rows = rows.where(F.col("alias_norm").contains(" ") | (F.col("alias_norm").isin(single) if single else F.lit(False)))
    counts = rows.groupBy("concept_type", "alias_norm").agg(F.min_by("text", F.struct("concept_id", "text")).alias("term"), F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    return counts.where(~F.col("alias_norm").isin(stop)) if stop else counts


def majority_types(gold: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """(alias_norm, concept_type, n, share) of the dominant type of phrases that occur often enough."""
    counts = gold.select(normalize_key(F.col("text")).alias("alias_norm"), "concept_type").where("alias_norm <> ''").groupBy("alias_norm", "concept_type").agg(F.count("*").alias("n"))
    totals = counts.groupBy("alias_norm").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return counts.join(totals, "alias_norm").where((F.col("n") == F.col("top")) & (F.col("total") >= least) & (F.col("n") >= F.col("total") * share)).select("alias_norm", "concept_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def supplemental(gold: DataFrame, kb: DataFrame) -> DataFrame:
    """(concept_type, code, name, support): coded labels that the terminology lacks, under their most frequent surface form."""
    rows = gold.select("concept_type", "text", F.explode("candidates").alias("code")).join(kb.select("concept_type", "code").distinct(), ["concept_type", "code"], "left_anti")
    names = rows.groupBy("concept_type", "code", "text").agg(F.count("*").alias("n"))
    return names.groupBy("concept_type", "code").agg(F.max_by("text", F.struct("n", "text")).alias("name"), F.sum("n").alias("support"))


def restored(current: DataFrame, older: DataFrame, also: list[str] | None = None) -> DataFrame:
    """current with empty candidates taken from the older version's concept at the same place, text and type, and of equal `also` columns."""
    key = [*(also or []), "doc_id", "char_position", "text", "concept_type"]
    old = older.where(F.size("candidates") > 0).groupBy(*key).agg(F.min("candidates").alias("old_candidates"))
    return current.join(old, key, "left").withColumn("restored", F.when(F.size("candidates") == 0, F.coalesce("old_candidates", "candidates")).otherwise(F.col("candidates"))).drop("old_candidates")
