"""Problem 3: differences between two copies of a dataset, field by field.

Method: a matrix of additive checksums, one cell per key bucket and column. Each side is hashed once: rows become narrow states
(key, version, one 64-bit hash per column) and are grouped by key in one map-side-combined shuffle. Sums of 48 bits of the
hashes, those of the other side subtracted, make up the matrix; a cell that isn't zero is unequal. States of equal buckets
are dropped before the join, and in the others only the columns whose cells are unequal are compared.

Matrix and join read the same two shuffles. A bucket is a residue of the hash by which Spark partitions the keys, and the
number of buckets a multiple of the number of partitions, so that every bucket lies in one partition: the matrix adds one
row per bucket to what is shuffled. Unequal cells are broadcast as bits, 64 buckets in a word, of which there are never more
than MOST_BUCKETS / 64; beyond that many buckets they hold more keys, and the join compares more of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.functions.visual import consistent_form

MOST_BUCKETS = 1 << 25
EXPECTED_SHARE = 0.03  # of the keys differ: sets the size of buckets


def elements(array: Column) -> Column:
    """An array's elements as strings in which a null element differs from every value."""
    return F.transform(array, lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("null")))


def array_hash(array: Column, as_set: bool = False) -> Column:
    """Null, the empty array and any values hash apart; as_set ignores order and repeats."""
    items = elements(array)
    return F.xxhash64(F.coalesce(F.size(items) if not as_set else F.size(F.array_distinct(items)), F.lit(-2)), F.array_sort(F.array_distinct(items)) if as_set else items)


def value_hash(value: Column) -> Column:
    return F.xxhash64(value.isNull(), value)


def latest_hashes(rows: DataFrame, key: str, version: str, hashes: dict[str, Column]) -> DataFrame:
    """(key, state): per key the hashes of the row with the latest version; null versions are the oldest, ties go to the largest hashes."""
    narrow = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(F.col(version).alias("version"), *(c.alias(n) for n, c in hashes.items())).alias("state"))
    return narrow.groupBy("key").agg(F.max("state").alias("state"))


def n_buckets(spark: SparkSession, keys: int, expected_share: float = EXPECTED_SHARE) -> int:
    """How many buckets for so many keys: the cost of the matrix a key (1 / size of a bucket) and of the keys that are compared
    because they share a bucket with a difference (share * size) are about equal. A multiple of the number of partitions."""
    size = max(1, round(expected_share**-0.5))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return partitions * max(1, min(MOST_BUCKETS, max(64, keys // size)) // partitions)


def _bucket(buckets: int) -> Column:
    return F.coalesce(F.pmod(F.hash("key"), F.lit(buckets)), F.lit(0))  # never null, so that no filter on it is added to the plan


def unequal_cells(left: DataFrame, right: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """(bucket, keys_differ, a flag per column) of the buckets with a difference; a key on one side alone leaves all cells unequal."""
    part = lambda h: F.shiftrightunsigned(h, 16)  # 48 bits: sums can't overflow
    signed = [t.select(_bucket(buckets).alias("bucket"), *((part(F.xxhash64("key", *c)) * sign).alias(n) for n, c in [("keys_differ", []), *((c, [F.col("state")[c]]) for c in columns)])) for t, sign in ((left, 1), (right, -1))]
    names = ["keys_differ", *columns]
    cells = signed[0].unionByName(signed[1]).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
    return cells.select("bucket", *((F.col(n) != 0).alias(n) for n in names)).where(reduce(lambda x, y: x | y, (F.col(n) for n in names)))


def _bits(cells: DataFrame, names: list[str]) -> DataFrame:
    """Unequal cells as bits of words of 64 buckets."""
    bit = F.expr("shiftleft(1L, bucket & 63)")
    return cells.groupBy(F.expr("bucket >> 6").alias("_word")).agg(F.bit_or(bit).alias("_any"), *(F.bit_or(F.when(F.col(n), bit).otherwise(F.lit(0).cast("long"))).alias(n) for n in names))


def copy_differences(left: DataFrame, right: DataFrame, columns: list[str], rows: int, names: tuple[str, str], expected_share: float = EXPECTED_SHARE) -> DataFrame:
    """(key, difference): `only_in_<name>` or the name of a column that differs, a row each, from two latest_hashes tables.

    Rows with a null key were left out by latest_hashes, as they can't be told to be the same record. Two empty tables give
    no rows. `rows` (an estimate will do) and the expected share of differing keys set the number of buckets.
    """
    buckets = n_buckets(left.sparkSession, rows, expected_share)
    bits = F.broadcast(_bits(unequal_cells(left, right, columns, buckets), columns))
    at = F.expr("bucket & 63")
    suspects = lambda side: side.withColumn("bucket", _bucket(buckets)).withColumn("_word", F.expr("bucket >> 6")).join(bits, "_word").where(F.getbit("_any", at) == 1)
    a, b = suspects(left).alias("a"), suspects(right).alias("b")
    both = a.join(b, F.col("a.key") == F.col("b.key"), "full")
    one_side = F.when(F.col("b.key").isNull(), F.lit(f"only_in_{names[0]}")).when(F.col("a.key").isNull(), F.lit(f"only_in_{names[1]}"))
    fields = [F.when((F.getbit(f"a.{c}", F.expr("a.bucket & 63")) == 1) & (F.col(f"a.state.{c}") != F.col(f"b.state.{c}")), F.lit(c)) for c in columns]
    found = F.when(one_side.isNotNull(), F.array(one_side)).otherwise(F.filter(F.array(*fields), lambda x: x.isNotNull()))
    return both.select(F.coalesce("a.key", "b.key").alias("key"), F.explode(found).alias("difference"))


def annotation_hashes(rows: DataFrame, version: str) -> DataFrame:
    """latest_hashes of a table of annotations: type as it looks, position and candidates in order, assertions as a set."""
    return latest_hashes(
        rows,
        "concept_id",
        version,
        {
            "concept_type": value_hash(consistent_form(F.col("concept_type"))),
            "char_position": array_hash(F.col("char_position")),
            "assertions": array_hash(F.col("assertions"), as_set=True),
            "candidates": array_hash(F.col("candidates")),
        },
    )


ANNOTATION_FIELDS = ["concept_type", "char_position", "assertions", "candidates"]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    concepts, mirror = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("concepts", "concepts_mirror"))
    n = concepts.count()  # from the file footers
    found = copy_differences(annotation_hashes(concepts, "received_at"), annotation_hashes(mirror, "synced_at"), ANNOTATION_FIELDS, n, ("concepts", "mirror"))
    return found.withColumnRenamed("key", "concept_id")


def p3_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Per column of the checksum matrix, in how many buckets its cells differ."""
    concepts, mirror = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("concepts", "concepts_mirror"))
    cells = unequal_cells(annotation_hashes(concepts, "received_at"), annotation_hashes(mirror, "synced_at"), ANNOTATION_FIELDS, n_buckets(spark, concepts.count()))
    return cells.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("differs")) for c in ("keys_differ", *ANNOTATION_FIELDS)))).alias("x")).groupBy("x.column_name").agg(F.count_if("x.differs").alias("n_unequal"))
