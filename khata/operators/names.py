"""Likely misspellings among names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.session import written


def _places(text: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))


def _cut(text: Column, i: Column, filler: str) -> Column:
    return F.concat(F.substr(text, F.lit(1), i - 1), F.lit(filler), F.substr(text, i + 1))


def _shorter(text: Column) -> Column:
    """The text without one of its letters, for each of them."""
    return F.array_distinct(F.transform(_places(text), lambda i: _cut(text, i, "")))


def _blanked(text: Column) -> Column:
    """The text with one place blanked out, for each place, marked with the place."""
    return F.transform(_places(text), lambda i: F.concat(i.cast("string"), F.lit("\x01"), _cut(text, i, "\x02")))


def _meeting_places(via: Column) -> Column:
    """(key, side) of all meetings of a hub; see :func:`_within_two`."""
    kind, rest = F.substr(via, F.lit(1), F.lit(1)), F.substr(via, F.lit(2))
    marked = F.split(rest, "\x01", 2)
    at, text = marked[0].cast("int"), marked[1]

    def places(keys: Column, side: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(side).alias("side")))

    left = F.when(at > 1, F.sequence(F.lit(1), at - 1)).otherwise(F.array().cast("array<int>"))
    twice = F.transform(left, lambda i: F.concat(F.lit("t"), i.cast("string"), F.lit("\x01"), at.cast("string"), F.lit("\x01"), _cut(text, i, "\x02")))
    itself = F.array(F.struct(via.alias("key"), F.lit(1).alias("side")))
    shorter = places(F.transform(_shorter(rest), lambda k: F.concat(F.lit("o"), k)), 0)
    blanked = places(F.transform(_blanked(rest), lambda k: F.concat(F.lit("b"), k)), 0)
    return F.when(kind == "o", itself).when(kind == "b", F.concat(itself, places(twice, 2))).otherwise(F.concat(shorter, blanked))


def _within_two(names: DataFrame) -> DataFrame:
    """(name, uses, best) where ``best`` is at most two edits away; all that may be the best are there.

    Names stand at hubs: the name itself (o), the name without a letter (d), the name with a place blanked (b). Only hubs, with
    their best name, go on to meet, so what many names share is worked out once: d without a further letter meets o, d with a
    place blanked meets b, and b with a place further left blanked meets its like. Every meeting is one shuffle for both sides,
    and only better names go back, to the hubs and from there to the names.
    """
    names, text, me = written(names, "names"), F.col("name"), F.struct("uses", "name")

    def kind(letter: str, forms: Column) -> Column:
        return F.transform(forms, lambda f: F.concat(F.lit(letter), f))

    spots = F.concat(kind("o", F.array(text)), kind("d", _shorter(text)), kind("b", _blanked(text)))
    stands = names.select("name", "uses", F.explode(spots).alias("via"))
    hubs = written(stands.groupBy("via").agg(F.max(me).alias("best")), "hubs")
    met = hubs.select("via", "best", F.explode(_meeting_places(F.col("via"))).alias("m")).select("via", "best", "m.*")
    # as many names as there are letters, or pairs of them, stand at a key, so no group is large
    at = Window.partitionBy("key")
    there = [F.max(F.when(F.col("side") == s, F.col("best"))).over(at).alias(f"best_{s}") for s in (0, 1, 2)]
    side = F.col("side")
    given = F.when(side == 0, F.col("best_1")).when(side == 1, F.col("best_0")).otherwise(F.col("best_2"))
    back = met.select("via", "best", "side", *there).withColumn("given", given).where(F.col("given") > F.col("best"))
    # an explode counts as large as what it is made of, so without hints its rows would be broadcast by way of the driver
    better = hubs.join(back.groupBy("via").agg(F.max("given").alias("given")).hint("merge"), "via", "left")
    return stands.hint("merge").join(better.select("via", F.coalesce("given", "best").alias("best")), "via").select("name", "uses", "best")


def likely_spelling(df: DataFrame, name: str, edits: int = 1) -> DataFrame:
    """For every distinct name: the most frequent name at most ``edits`` (1 or 2) edits away, if more frequent than itself.

    Names meet in patterns of a kind in which any two of them are that near: places blanked out in both, letters left out of
    both, or letters left out of the longer one and places blanked out. So a pattern keeps only its most frequent name, no
    distance has to be worked out, and names are never paired with all their like.
    """
    if edits not in (1, 2):
        raise ValueError("one or two edits")
    names = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    text, me = F.col("name"), F.struct("uses", "name")

    def spelled(rows: DataFrame, forms: Column) -> DataFrame:
        return rows.select("name", "uses", F.explode(forms).alias("key"))

    def meeting(rows: DataFrame, others: DataFrame) -> DataFrame:
        return rows.join(others.groupBy("key").agg(F.max(me).alias("best")), "key").select("name", "uses", "best")

    if edits == 2:
        found = _within_two(names)
    else:
        own = names.withColumn("key", text)
        blanked, shorter = spelled(names, _blanked(text)), spelled(names, _shorter(text))
        found = reduce(DataFrame.unionByName, [meeting(blanked, blanked), meeting(own, shorter), meeting(shorter, own)])
    found = found.where(F.col("best") > me)
    return found.groupBy("name", "uses").agg(F.max("best").alias("b")).select(
        "name", "uses", F.col("b.name").alias("likely"), F.col("b.uses").alias("likely_uses"))
