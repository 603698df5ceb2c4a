"""Notes given in a program to concepts: what a service would answer, without the service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.config import Settings
from ontospan.operators.proposer import Proposer
from ontospan.plans.pipeline import Tables, annotated
from ontospan.sources.writers import concept_rows


def predict_batch(spark: SparkSession, texts: list[str], lexicon: DataFrame, kb: DataFrame, ask: Proposer | None = None, settings: Settings | None = None, tables: Tables | None = None) -> list[list[dict]]:
    """The concepts of each text, in order; every text must have a character. For requests: large sets of notes are tables."""
    if not all(isinstance(t, str) and t for t in texts):
        raise ValueError("a text must have at least one character")
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: [{k: v for k, v in c.asDict(recursive=True).items() if v is not None} for c in r.concepts] for r in concept_rows(annotated(documents, lexicon, kb, ask, settings, tables)).collect()}
    return [rows.get(i, []) for i in range(len(texts))]


def predict(spark: SparkSession, text: str, lexicon: DataFrame, kb: DataFrame, **more) -> list[dict]:
    return predict_batch(spark, [text], lexicon, kb, **more)[0]


def predict_files(spark: SparkSession, folder: str, out: str, lexicon: DataFrame, kb: DataFrame, **more) -> dict[str, int]:
    """A folder of notes to one file of concepts each; the number of concepts with problems, by problem, and of notes."""
    from ontospan.sources.readers import read_notes
    from ontospan.sources.writers import write_files

    notes = read_notes(spark, folder).select(F.col("name").alias("doc_id"), "text")
    found = annotated(notes, lexicon, kb, **more)
    write_files(found, out)
    wrong = found.select(F.explode("problems").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    return {r.p: r.n for r in wrong} | {"notes": notes.count()}
