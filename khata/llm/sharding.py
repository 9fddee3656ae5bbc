"""Rendezvous hashing: every record goes to the shard that draws the best lot for the record's key.

A shard's lot for a key is ``-weight / ln(u)`` with u from a hash of key and shard number, so a shard is chosen in
proportion to its weight, and a new shard only takes records into itself. Built of DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.llm.frames import packed

#: Cells per shard in which slots are numbered side by side.
CELLS = 4096
#: Slots of equal rows that are made at a time.
BLOCK = 4096


def lot(key: Column, shard: int, weight: float) -> Column:
    """Draw of one shard for a key: u lies strictly between 0 and 1, so the logarithm is finite and negative."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the largest lot (the later one in a tie). Null keys are a key of their own."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("one positive weight per shard")
    return F.greatest(*[F.struct(lot(key, i, w).alias("lot"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])["shard"] \
        if len(weights) > 1 else F.lit(0)


def assign(df: DataFrame, key: str, weights: list[float], more: float = 1.0) -> DataFrame:
    """(row, shard, grown_shard): every row as a struct, its shard, and its shard when one of weight ``more`` is added.

    Row by row, without a shuffle. Rows with equal keys share a shard; null is a key. An empty table stays empty.
    """
    k = F.col(f"`{key}`")
    return packed(df, shard=shard_of(k, weights), grown_shard=shard_of(k, [*weights, more]))


def numbered(df: DataFrame, shard: str, *order: str) -> DataFrame:
    """``df`` with ``slot``: places 0, 1, 2 ... in each shard, without a gap and without one task per shard.

    Rows are dealt into cells by a hash of the order columns, and counted by cell; slots start at the sum of the cells
    before. The counts are at most ``CELLS`` rows per shard, which bounds what is broadcast. Equal rows are counted
    before they are shuffled and spread again afterwards, so a row that repeats without end is one row on the way.
    """
    cell = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(CELLS)).cast("int")
    rows = df.withColumn("cell", cell).groupBy("cell", *df.columns).agg(F.count("*").alias("copies"))
    counts = df.select(shard, cell.alias("cell")).groupBy(shard, "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(shard, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(counts), [shard, "cell"]).withColumn(
        "base", F.col("base") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    last = F.col("base") + F.col("copies") - 1
    blocks = placed.withColumn("at", F.explode(F.sequence(F.col("base"), last, F.lit(BLOCK))))
    slots = F.sequence(F.col("at"), F.least(F.col("at") + (BLOCK - 1), last))
    return blocks.withColumn("slot", F.explode(slots)).select(*df.columns, "slot")
