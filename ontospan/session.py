"""Session helpers: the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests only)."""
    sc = spark.sparkContext
    if (set_already := sc.getCheckpointDir()) is not None:
        return set_already
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ontospan-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that a lost executor costs nothing and nothing is worked out twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, most_rows: int) -> bool:
    """Whether a table holds at most most_rows rows; it is counted up to one more."""
    return df.limit(most_rows + 1).count() <= most_rows


def small_or_shuffled(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint if the table is_small; otherwise the join may shuffle."""
    return F.broadcast(df) if is_small(df, most_rows) else df
