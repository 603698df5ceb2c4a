"""Problems 3 and 6: small cases, nulls, repeats, ties, empty tables, clashing columns, and brute force on random tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ontospan.operators import copies, snapshots

AT = dt.datetime(2030, 1, 1)
SCHEMA = "concept_id long, concept_type string, char_position array<int>, assertions array<string>, candidates array<string>, version timestamp, key string, state int, bucket int"


def row(i, t="A", p=(1, 2), a=(), c=None, day=0):
    listed = lambda x: None if x is None else list(x)
    return (i, t, listed(p), listed(a), listed(c), AT + dt.timedelta(days=day), "k", 1, 2)


def differences(spark, left, right):
    tables = (copies.annotation_hashes(spark.createDataFrame(x, SCHEMA), "version") for x in (left, right))
    return sorted((r.key, r.difference) for r in copies.copy_differences(*tables, copies.ANNOTATION_FIELDS, len(left), ("concepts", "mirror")).collect())


def test_fields_and_sides(spark):
    left = [row(1), row(2), row(3, c=()), row(4, a=("x", "y")), row(5, p=None), row(6, t="Đ"), row(None), row(8, c=("a", "b")), row(9, c=(None,))]
    right = [row(1), row(7), row(3, c=None), row(4, a=("y", "x", "x")), row(5, p=()), row(6, t="Ð"), row(None), row(8, c=("b", "a")), row(9, c=())]
    assert differences(spark, left, right) == [(2, "only_in_concepts"), (3, "candidates"), (5, "char_position"), (7, "only_in_mirror"), (8, "candidates"), (9, "candidates")]


def test_latest_row_counts_and_repeats_do_not(spark):
    left = [row(1, c=("new",)), row(1, c=("new",))]
    right = [row(1, c=("old",), day=1), row(1, c=("new",), day=2), row(1, c=("old",), day=0)]
    assert differences(spark, left, right) == []
    assert differences(spark, left, right[:1]) == [(1, "candidates")]


def test_empty_tables(spark):
    assert differences(spark, [], []) == []
    assert differences(spark, [row(1)], []) == [(1, "only_in_concepts")]


def test_copies_by_brute_force(spark):
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    make = lambda i: row(i, pick("A", "A", "B"), pick((1, 2), (1, 3)), pick((), ("x",)), pick(None, (), ("c",)))
    left = [make(i) for i in range(2000) if rng.random() < 0.95]
    same = {r[0]: r for r in left}
    right = [same[i] if i in same and rng.random() < 0.9 else make(i) for i in range(2000) if rng.random() < 0.95]
    expected, other = [], {r[0]: r for r in right}
    for i in sorted(same.keys() | other.keys()):
        if i not in other:
            expected.append((i, "only_in_concepts"))
        elif i not in same:
            expected.append((i, "only_in_mirror"))
        else:
            expected += [(i, f) for f, a, b in zip(copies.ANNOTATION_FIELDS, same[i][1:5], other[i][1:5]) if a != b]
    assert differences(spark, left, right) == sorted(expected)


def test_unequal_cells(spark):
    """Whatever the number of buckets: exactly the buckets of the differing keys, and of these the columns that differ."""
    states = lambda rows: rows.select(F.col("id").alias("key"), F.struct(F.lit(0).alias("version"), F.col("v"), F.col("w")).alias("state"))
    left = spark.range(1000).select("id", F.xxhash64("id").alias("v"), F.lit(7).cast("long").alias("w"))
    right = left.where("id <> 5").withColumn("v", F.when(F.col("id") == 70, 1).otherwise(F.col("v")))
    for buckets in (1, 16, 4096):
        of = {i: spark.range(i, i + 1).select(F.pmod(F.hash("id"), F.lit(buckets))).first()[0] for i in (5, 70)}
        got = {r.bucket: (r.keys_differ, r.v, r.w) for r in copies.unequal_cells(states(left), states(right), ["v", "w"], buckets).collect()}
        assert got == ({of[70]: (False, True, False)} | {of[5]: (True, True, True)} if of[5] != of[70] else {of[5]: (True, True, True)})


def test_number_of_buckets(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert copies.n_buckets(spark, 0) >= n and copies.n_buckets(spark, 10**7) % n == 0 and copies.n_buckets(spark, 10**12) <= copies.MOST_BUCKETS
    assert copies.n_buckets(spark, 10**6, 0.5) > copies.n_buckets(spark, 10**6, 0.001)


STATES = "snapshot_no int, concept_id long, text string, char_position array<int>, candidates array<string>, loaded_at timestamp, pair int, new string"


def changes(spark, rows):
    df = spark.createDataFrame([(n, i, t, p, c, None if day is None else AT + dt.timedelta(days=day), 0, "") for n, i, t, p, c, day in rows], STATES)
    out = snapshots.snapshot_changes(df, "concept_id", "snapshot_no", "loaded_at", snapshots.annotation_hash())
    return sorted((r.snapshot_no, r.key, r.change_kind) for r in out.collect())


def test_snapshots(spark):
    rows = [(1, 1, "a", [1, 2], None, 0), (2, 1, "a​", [1, 2], None, 9), (3, 1, "a", [1, 2], [], 0), (1, 2, "x", [], None, 0), (3, 2, "x", [], None, 0), (2, 3, None, None, None, 0), (3, 3, None, None, None, None), (None, 9, "a", None, None, 0), (2, None, "a", None, None, 0)]
    assert changes(spark, rows) == [(2, 2, "removed"), (2, 3, "added"), (3, 1, "changed"), (3, 2, "added")]
    assert changes(spark, []) == []
    assert changes(spark, [(1, 1, "a", None, None, 0)]) == []


def test_the_latest_load_counts(spark):
    rows = [(1, 1, "a", None, None, 0), (2, 1, "b", None, None, 1), (2, 1, "a", None, None, 5), (2, 1, "b", None, None, None), (2, 1, "b", None, None, 2)]
    assert changes(spark, rows) == []
