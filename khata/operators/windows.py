"""Running totals that do not need one task per group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key is a key like any other."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if not keys:
        return left.join(renamed)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_k_{k}" for k in keys])


def running_total(df: DataFrame, value: str, time: str, order: list[str], name: str,
                  keys: list[str] | None = None, levels: tuple[str, ...] = ("day", "minute")) -> DataFrame:
    """Add ``name``: sum of ``value`` over all rows up to this one in (time, order).

    A plain unbounded window would sort a whole key in one task. Here rows are
    split into time buckets, coarse to fine; each bucket adds up on its own, and
    the totals of the buckets before it, which are few, are added as an offset.
    Rows with a null time come first; a null key is a key of its own.
    """
    keys = keys or []
    buckets = [f"_b{i}" for i in range(len(levels))]
    work = df.withColumns({b: F.date_trunc(level, F.col(time)) for b, level in zip(buckets, levels)})

    sums = work.groupBy(*keys, *buckets).agg(F.sum(value).alias("_s"))
    for depth in range(len(levels)):
        inside = keys + buckets[:depth]
        level_sum = sums.groupBy(*inside, buckets[depth]).agg(F.sum("_s").alias("_t"))
        before = (Window.partitionBy(*inside).orderBy(buckets[depth])
                  .rowsBetween(Window.unboundedPreceding, -1))
        step = level_sum.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
        if depth == 0:
            offsets = step
        else:
            offsets = (null_safe_join(step.withColumnRenamed("_o", "_n"), offsets, inside)
                       .withColumn("_o", F.col("_o") + F.col("_n")).drop("_n"))

    inside = Window.partitionBy(*keys, *buckets).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    return (null_safe_join(work.withColumn("_r", F.sum(value).over(inside)), offsets, keys + buckets)
                .withColumn(name, F.col("_r") + F.col("_o"))
                .drop("_r", "_o", *buckets))
