"""Problem 2: how often every distinct term occurs and in how many documents, with marks for too rare and too common.

Method: range-partitioned external sort of (term, document) pairs and a run-length scan. repartitionByRange samples the
pairs and gives every task a slice of the sorted order, so a term that holds a third of all rows is spread over as many
tasks as its documents fill. The scan is three sort aggregates over that order: the aggregates carry a string, which
makes Spark sort each slice (spilling where it must) and read the runs in order without another exchange. Only one row per term and
slice is shuffled for the final sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.functions.visual import consistent_form


def term_counts(rows: DataFrame, term: list[str], document: str, row_id: str, sample: str) -> DataFrame:
    """Per term its n_rows (distinct row ids: a row delivered again counts once), n_docs and the smallest `sample`.

    A null in a term column is a value of its own. Rows with a null document count as rows in no document; rows with a null
    row id count once per term and document. An empty table gives no rows.
    """
    runs = rows.select(*term, document, row_id, sample).repartitionByRange(*term, document)
    smallest = F.min(sample).alias(sample)
    one_row = runs.groupBy(*term, document, row_id).agg(smallest)
    one_document = one_row.groupBy(*term, document).agg(F.count("*").alias("n_rows"), smallest)
    return one_document.groupBy(*term).agg(F.sum("n_rows").alias("n_rows"), F.count(document).alias("n_docs"), smallest)


def marked(counts: DataFrame, documents: int | DataFrame, rare_docs: int = 1, common_share: float = 0.05):
    """Adds mark: `rare` in at most rare_docs documents, `common` in at least common_share of all, else null. Rare wins."""
    total = documents.scalar() if isinstance(documents, DataFrame) else F.lit(documents)
    return counts.withColumn("mark", F.when(F.col("n_docs").between(1, rare_docs), "rare").when(F.col("n_docs") >= F.lit(common_share) * total, "common"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    concepts = spark.read.parquet(f"{sf}/concepts.parquet")
    return concepts.where(F.col("text").isNotNull()).select("concept_type", F.lower(consistent_form(F.col("text"))).alias("term_value"), "doc_id", "concept_id", "text")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct pair of type and term with its rows, documents, a sample as typed, and its mark."""
    documents = spark.read.parquet(f"{sf}/concepts.parquet").agg(F.countDistinct("doc_id").alias("n"))
    return marked(term_counts(_values(spark, sf), ["concept_type", "term_value"], "doc_id", "concept_id", "text"), documents)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    # the sample stays in the plan: without a string to carry, Spark would count by hashing in place of the sorted scan
    return p2_terms(spark, sf).where(F.col("mark").isNotNull() & F.col("text").isNotNull()).select("concept_type", "term_value", "mark")
