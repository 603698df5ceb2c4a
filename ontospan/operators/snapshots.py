"""Problem 6: what changed between consecutive full snapshots.

Method: both snapshots of a pair are united, tagged by side, grouped by key and classified from per-side row hashes, all
in one aggregation shuffle. Rows are reduced to (key, snapshot, load time, row hash) and the newest state per key and
snapshot is taken with a map-side combine, so a key that is delivered over and over is folded before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.functions.visual import consistent_form
from ontospan.operators.copies import array_hash, value_hash


def snapshot_changes(rows: DataFrame, key: str, snapshot: str, loaded: str, row_hash: Column) -> DataFrame:
    """(snapshot, key, change_kind): `added`, `removed` or `changed` against the snapshot numbered one less.

    The state of a key in a snapshot is that of the row loaded last (null counts as earliest, ties go to the larger hash);
    the snapshot number alone says where a row belongs. The first snapshot has nothing before it and gives no rows, nor does
    the one after the last. Rows with a null key or snapshot number are left out. An empty table gives no rows.
    """
    state = F.struct(F.col(loaded).alias("at"), row_hash.alias("h"))
    narrow = rows.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(F.col(key).alias("key"), F.col(snapshot).cast("int").alias("n"), state.alias("state"))
    # snapshot n is the new side of pair n and the old side of pair n + 1
    sides = F.explode(F.array(F.struct(F.col("n").alias("pair"), F.lit(True).alias("new")), F.struct((F.col("n") + 1).alias("pair"), F.lit(False).alias("new"))))
    tagged = narrow.select("key", "state", sides.alias("side")).select("key", "side.pair", F.when(F.col("side.new"), F.col("state")).alias("new"), F.when(~F.col("side.new"), F.col("state")).alias("old"))
    bounds = narrow.agg(F.struct(F.min("n").alias("first"), F.max("n").alias("last"))).scalar()
    both = tagged.groupBy("key", "pair").agg(F.max("new").alias("new"), F.max("old").alias("old")).where((F.col("pair") > bounds["first"]) & (F.col("pair") <= bounds["last"]))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.h") != F.col("new.h"), "changed")
    return both.select(F.col("pair").alias("snapshot_no"), "key", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())


def annotation_hash() -> Column:
    """Text as it looks, position and ranked candidates in order; null, the empty array and values differ."""
    return F.xxhash64(value_hash(consistent_form(F.col("text"))), array_hash(F.col("char_position")), array_hash(F.col("candidates")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/concept_snapshots.parquet")
    return snapshot_changes(rows, "concept_id", "snapshot_no", "loaded_at", annotation_hash()).select("snapshot_no", F.col("key").alias("concept_id"), "change_kind")


def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of changes by snapshot and kind."""
    return p6_found(spark, sf).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n"))
