"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups, and a proof for every row.

H is lowercase hex SHA-256 over concatenated inputs. A leaf is H of a row's fields. The leaves of a group stand by key; as
long as there are several nodes, every ``RUN`` neighbours (at the end fewer, even one) become their H. What is left is the
group's subroot, and the subroots by group (null first, bytewise) give the root in the same way.

Nodes are dealt into aligned blocks of ``BLOCK``. A block keeps each of its levels as one hex string, in which node i has the
characters from 64 i on, so that parents are hashes of substrings of a fixed width, and the siblings of a node are what
stands left and right of it in its run's substring. The roots of the blocks are the nodes of the next round.

Nulls: a null field is ``-``; a null key stands first in its group; null is a group of its own. Empty texts are ``0:``. Rows
of one key stand by leaf; equal rows are leaves of their own with neighbouring places. An empty table gives no rows. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.llm.frames import kept

#: Children of a node, levels that a block goes up, and nodes of a block.
RUN, RISE = 8, 3
BLOCK = RUN**RISE
HEX = 64


def leaf(*fields: Column) -> Column:
    """H of the fields: each ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*framed), 256)


def placed(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """``nodes`` (group, ...) with ``place``, the number of a node in its group by ``order``, and ``total``, the group's size.

    One sort by ranges over all groups; a hot group is spread over many ranges, and so are nodes that are equal in all of
    ``order``. Places are counted within a range, to which the counts of the ranges before are added.
    """
    ranged = nodes.repartitionByRange("group", *order, F.rand(0)).withColumn("part", F.spark_partition_id())
    ranged = kept(ranged, label)
    sizes = ranged.groupBy("group", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("group", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
                          F.sum("size").over(Window.partitionBy("group")).alias("total"))
    within = F.row_number().over(Window.partitionBy("group", "part").orderBy(*order))
    return ranged.withColumn("within", within).join(starts, ["group", "part"]).withColumn(
        "place", F.col("start") + F.col("within") - 1).drop("part", "start", "within")


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (RUN * HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * (RUN * HEX) + 1, F.lit(RUN * HEX)), 256)), "")


def blocks(nodes: DataFrame, label: str) -> DataFrame:
    """(group, total, block, members, level0 to level2, rise, root) from ``nodes`` (group, place, total, digest, carried).

    The only block of a group rises until one node is left; each of several rises ``RISE`` levels.
    """
    grouped = nodes.groupBy("group", "total", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "carried"))).alias("members"))
    rise = F.lit(0)
    for n in range(RISE):
        rise = F.when(F.col("total") > RUN**n, n + 1).otherwise(rise)
    up = grouped.withColumn("rise", rise).withColumn("level0", F.array_join("members.digest", ""))
    for n in range(1, RISE + 1):
        up = up.withColumn(f"level{n}", F.when(F.col("rise") >= n, _parents(F.col(f"level{n - 1}"))))
    root = F.coalesce(*[F.col(f"level{n}") for n in range(RISE, -1, -1)])
    return kept(up.withColumn("root", root).drop(f"level{RISE}"), label)


def rounds(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The blocks over the leaves, those over their roots, and so on until every group is down to one block."""
    found = [blocks(nodes, f"{label}-0")]
    while not (several := found[-1].where(F.col("total") > BLOCK)).isEmpty():
        above = several.select("group", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"),
                               F.col("root").alias("digest"), F.lit(None).cast("boolean").alias("carried"))
        found.append(blocks(above, f"{label}-{len(found)}"))
    return found


def _flanks(place: Column) -> Column:
    """(left, right) of a node and of its ancestors in the block, lowest first: the run's other nodes as hex text."""
    spot, each = F.pmod(place, F.lit(BLOCK)).cast("int"), []
    for n in range(RISE):
        node = F.floor(spot / RUN**n).cast("int")
        run = F.substr(F.col(f"level{n}"), F.floor(node / RUN).cast("int") * (RUN * HEX) + 1, F.lit(RUN * HEX))
        at = F.pmod(node, F.lit(RUN)) * HEX
        sides = F.struct(F.substr(run, F.lit(1), at).alias("left"), F.substr(run, at + HEX + 1, F.lit(RUN * HEX)).alias("right"))
        each.append(F.when(F.col("rise") > n, sides))
    return F.filter(F.array(*each), lambda s: s.isNotNull())


def paths(found: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(group, place, digest, carried, path, and the columns of ``tops``) of every leaf.

    ``tops``: (group, path, ...) of every group; its path continues that of the group's root. Paths come down block by block:
    only blocks are joined, never leaves.
    """
    down = None
    for level in reversed(found):
        level = level.drop("root")
        here = level.where(F.col("total") <= BLOCK).join(tops, "group")
        if down is not None:
            above = down.withColumnRenamed("place", "block").drop("digest", "carried")
            here = here.unionByName(level.where(F.col("total") > BLOCK).join(above, ["group", "block"]))
        rest = [c for c in tops.columns if c not in ("group", "path")]
        down = here.select("*", F.explode("members").alias("one")).select(
            "group", "one.*", F.concat(_flanks(F.col("one.place")), "path").alias("path"), *rest)
    return down


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(rows: DataFrame, key: str, group: str, fields: list[str], carried: dict[str, Column]) -> DataFrame:
    """(leaf, subroot, root, path, carried) of every row; ``carried`` is a struct of expressions over the row.

    ``path`` lists (left, right) level by level from the leaf via the subroot to the root. Texts are read once and never
    moved; what is shuffled is a leaf's digest and what is carried.
    """
    name = lambda c: F.col(f"`{c}`")
    leaves = rows.select(F.concat(F.lit("="), name(group).cast("string")).alias("group"), name(key).alias("key"),
                         leaf(*map(name, fields)).alias("digest"), F.struct(*[v.alias(k) for k, v in carried.items()]).alias("carried"))
    leaves = leaves.withColumn("group", F.coalesce("group", F.lit("")))  # null before all others, and fit to be joined
    leaves = kept(leaves, "manifest-digests")  # the sort by ranges reads its input twice
    lower = rounds(placed(leaves, ["key", "digest"], "manifest-leaves").drop("key"), "manifest-blocks")
    subroots = lower[0].where(F.col("total") <= BLOCK).select("group", "root")
    for level in lower[1:]:
        subroots = subroots.union(level.where(F.col("total") <= BLOCK).select("group", "root"))
    named = subroots.select(F.lit("").alias("group"), F.col("root").alias("digest"), F.col("group").alias("carried"))
    upper = rounds(placed(named, ["carried"], "manifest-subroots"), "manifest-top")
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = upper[-1].select("group", "root", none.alias("path"))
    tops = paths(upper, top).select(F.col("carried").alias("group"), F.col("digest").alias("subroot"), "root", "path")
    return paths(lower, tops).select(F.col("digest").alias("leaf"), "subroot", "root", "path", "carried")
