"""Problem 1: text that looks the same in different characters.

Method: compatibility normalisation in composed form, mapped white space, removed default-ignorable characters and mapped
look-alike letters (functions.visual), worked out once per distinct value of an Arrow batch. Full case folding is an argument:
p1_folded has it on; p1_found has it off, since there another letter case looks different. Raised digits are kept for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.functions.visual import DIRTY, consistent_form


def with_form(df: DataFrame, column: str, into: str = "form", fold_case: bool = False) -> DataFrame:
    """Adds the consistent form of a text column, with fold_case also folded in full. Null gives null, a text without visible characters the empty string.

    A column named like `into` is replaced. No shuffle; rows in form already never reach Python.
    """
    return df.withColumn(into, consistent_form(F.col(column), fold_case))


def written_otherwise(df: DataFrame, row_id: str, column: str, terms: DataFrame, term_id: str, term: str) -> DataFrame:
    """(row_id, term_id) of the rows that look like a term and are not the same characters; each pair once.

    Only values with a character outside the consistent form can be such a row, so the others are filtered out in the scan
    before Python and join. Null ids, texts and terms match nothing; extra columns are ignored.
    """
    found = with_form(df.where(F.col(column).rlike(DIRTY)).select(F.col(row_id).alias("row_id"), F.col(column).alias("raw")), "raw")
    wanted = with_form(terms.select(F.col(term_id).alias("term_id"), F.col(term).alias("term")), "term", "term_form")
    return (
        found.join(wanted, (F.col("form") == F.col("term_form")) & (F.col("raw") != F.col("term")))
        .where(F.col("row_id").isNotNull())
        .select("row_id", "term_id")
        .distinct()
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = spark.read.parquet(f"{sf}/lexicon.parquet")
    sides = [("concepts", "concept_id", "text"), ("kb_records", "record_id", "record_name")]
    parts = [
        written_otherwise(spark.read.parquet(f"{sf}/{table}.parquet"), row_id, column, lexicon, "term_id", "term").select(
            F.lit(table).alias("source_table"), "row_id", "term_id"
        )
        for table, row_id, column in sides
    ]
    return parts[0].unionByName(parts[1])


def p1_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct consistent form of concepts.text with its rows and the number of ways it is written."""
    concepts = spark.read.parquet(f"{sf}/concepts.parquet").select("text")
    per_value = concepts.groupBy("text").agg(F.count("*").alias("n_rows"))  # each distinct value goes to Python once
    return (
        with_form(per_value, "text")
        .groupBy("form")
        .agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_spellings"), F.bool_or(F.col("text") != F.col("form")).alias("has_other_characters"))
    )


def p1_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct folded form of concepts.text with its rows and the number of letter cases in which it is written."""
    per_value = spark.read.parquet(f"{sf}/concepts.parquet").groupBy("text").agg(F.count("*").alias("n_rows"))
    both = with_form(with_form(per_value, "text"), "text", "folded", fold_case=True)
    return both.groupBy("folded").agg(F.sum("n_rows").alias("n_rows"), F.count_distinct("form").alias("n_cases"))
