"""Tables that belong together: union, totals, rankings and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_family(tables: dict[str, DataFrame], source: str = "source_table") -> DataFrame:
    """All rows of the family with the table they come from; columns a table lacks are null.

    Filters and column choices reach every scan. A family kept as one dataset
    partitioned by ``source`` needs no union at all; see ``write_family``.
    """
    named = [df.withColumn(source, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def write_family(df: DataFrame, path: str, source: str = "source_table") -> None:
    """Keep a family as one dataset with a folder per table, so a table filter prunes files."""
    df.write.mode("overwrite").partitionBy(source).parquet(path)


def total(df: DataFrame, amount: str) -> DataFrame:
    return df.agg(F.sum(amount).cast("double").alias("total_amount"))


def top_by_total(df: DataFrame, key: str, amount: str, n: int = 5) -> DataFrame:
    sums = df.groupBy(key).agg(F.sum(amount).alias("_t"))
    return sums.orderBy(F.desc("_t"), key).limit(n).select(key, F.col("_t").cast("double").alias("total_amount"))


def monthly_trend(df: DataFrame, day: str, amount: str) -> DataFrame:
    """Totals per month, in calendar order with the month's name."""
    sums = df.groupBy(F.trunc(day, "month").alias("_m")).agg(F.sum(amount).cast("double").alias("total"))
    return sums.orderBy("_m").select(F.year("_m").cast("bigint").alias("year"), F.month("_m").cast("bigint").alias("month_no"),
                                     F.date_format("_m", "MMMM").alias("month"), "total")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
