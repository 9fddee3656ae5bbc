"""Stores that are replaced as a whole: a write makes a new snapshot, a commit names it, and readers take the last one named.

A snapshot is a folder that is written once and never touched again, so a store may be overwritten with what was read from
it, readers in the midst of a write see the old rows to the end, and a write that breaks off leaves no trace for readers.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "number bigint, folder string"


def latest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the last committed snapshot, None where there is none."""
    try:
        named = spark.read.schema(COMMIT).json(f"{path}/commits/*").where("folder is not null")
        row = named.orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (row["number"], f"{path}/{row['folder']}") if row else None


def write(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next snapshot and commit it; returns its number.

    A commit whose number another writer has taken meanwhile is refused: what was read is no longer the last state.
    """
    spark, before = df.sparkSession, latest(df.sparkSession, path)
    number, folder = (before[0] if before else 0) + 1, f"snapshot-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{folder}")
    while True:
        try:
            spark.createDataFrame([(number, folder)], COMMIT).coalesce(1).write.json(f"{path}/commits/{number:08d}")
            return number
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            if (now := latest(spark, path)) and now[0] >= number:
                raise RuntimeError(f"{path} has been written by another job since it was read") from e
            number += 1  # a commit that broke off


def read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame | None:
    """Rows of the last committed snapshot, None where there is none."""
    found = latest(spark, path)
    return spark.read.schema(schema).options(**options).json(found[1]) if found else None
