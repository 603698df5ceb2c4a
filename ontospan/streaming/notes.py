"""An extension: notes as a stream. Stateless steps run unchanged; the terminology is a static side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.operators import proposals

SCHEMA = "doc_id long, text string, received_at timestamp"


def note_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def lexicon_counts(stream: DataFrame, lexicon: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, type, n) of lexicon phrases per event-time window; notes later than `late` are dropped by the watermark."""
    timed = stream.withWatermark("received_at", late)
    lines = timed.where(F.col("text").isNotNull()).select("received_at", F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select("received_at", "line", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("first_word"))
    terms = lexicon.select(F.lower("term").alias("term"), F.col("concept_type").alias("type")).distinct().withColumn("first_word", F.regexp_extract("term", r"^[\p{L}\p{N}_]+", 0)).where("first_word <> ''")
    hits = words.join(terms, "first_word").where(F.lower("line").contains(F.col("term")))
    return hits.groupBy(F.window("received_at", window).alias("window"), "type").agg(F.count("*").alias("n"))


def spans_in_batches(stream: DataFrame, lexicon: DataFrame, path: str, checkpoint: str):
    """Writes the spans of each micro-batch; a batch that is repeated after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        proposals.lexicon_spans(batch, lexicon).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


__all__ = ["SCHEMA", "lexicon_counts", "note_stream", "spans_in_batches"]
