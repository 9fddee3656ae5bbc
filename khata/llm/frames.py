"""Small helpers that the operators share: packed rows, shared paths, tables of a folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.session import written as kept


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """Every row as one struct ``row`` beside the named columns, so that no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in extra.items()])


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def connected(edges: DataFrame, label: str) -> DataFrame:
    """Components of an undirected graph, from ``edges`` (a, b) of long ids: rows (id, component), smallest id of each.

    Large-star and small-star steps in turn: every node links its larger neighbours to its smallest one. Each step is a
    grouping and a join, with its rows written to the shared folder; a component of n nodes takes about log(n) steps,
    and no step collects the neighbours of a node.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    links = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = mark(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = kept(large, label)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = kept(small.union(low.select("a", F.col("m").alias("b"))).distinct(), label)
        if (after := mark(links)) == before:
            break
        before = after
    stars = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def sized(texts: pa.Array, limit: int, rows: int) -> Iterator[tuple[int, int]]:
    """(start, number of rows) of slices of a string column: at most ``rows`` rows, and ``limit`` bytes or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > limit or i - start >= rows):
            yield start, i - start
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes) - start


def release() -> None:
    """At the end of a task: hand back what Arrow holds on to. Workers are used again by tasks of other operators."""
    pa.default_memory_pool().release_unused()
