"""Fixity audit of WARC archives: Merkle trees over the records of each replica, compared from the roots down.

A record stands in its archive at a place that its id alone decides, so a record that one replica has lost leaves the places of
all others as they are. A leaf is the SHA-256 of a record's bytes (of the count and sums of the digests where several stand at
one place). A node is the SHA-256 of its children's places, sizes and digests in order, that is, of a range of offsets counted
from its own start; it has ``FAN`` children at most. Two replicas are compared root by root; below a root that differs the
children are compared, and so on, so sound branches are never looked at.

Nulls: a null id has a place by its content, in archives of its own; other nulls are empty texts. Repeated rows, and rows of one
id, share a place and are judged together. An empty table has no trees. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.llm.frames import sized
from khata.session import shared_dir

#: Children of a node, places of an archive, and the level of the roots.
FAN, PER_ARCHIVE, TOP = 16, 4096, 3
#: Records with a null id are dealt into this many archives from this number on.
NULL_ARCHIVES, NULL_FROM = 64, -(1 << 60)


def record(url: Column, key: Column, body: Column) -> Column:
    """A WARC response record as text; nulls are empty."""
    none = F.lit("")
    body, url = F.coalesce(body, none), F.coalesce(url, none)
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), none),
                    F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """(archive, number, start, end, records, digest) of every place: where in its archive, how many records, and their digest.

    Archives take ``PER_ARCHIVE`` ids each in order.
    """
    k = F.col(f"`{key}`").cast("long")
    text = record(F.col(f"`{url}`"), k, F.col(f"`{body}`"))
    rows = pages.select(k.alias("key"), text.alias("text")).select(
        "key", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"))
    dealt = lambda n: F.pmod(F.xxhash64("digest", F.lit(n)), F.lit(n))
    return placed(rows.select(
        F.coalesce(F.floor(F.col("key") / PER_ARCHIVE), F.lit(NULL_FROM) + dealt(NULL_ARCHIVES)).cast("long").alias("archive"),
        F.coalesce(F.pmod("key", F.lit(PER_ARCHIVE)), dealt(PER_ARCHIVE)).cast("long").alias("number"), "size", "digest"))


def placed(records: DataFrame) -> DataFrame:
    """The manifest of ``records`` (archive, number, size, digest). Records of one place are put together by sums, before they are
    shuffled, so neither a repeated id nor a large archive gathers in one task."""
    words = [F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    one = records.groupBy("archive", "number").agg(F.count("*").alias("records"), F.sum("size").alias("size"), F.when(
        F.count("*") == 1, F.min("digest")).otherwise(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *words), 256)).alias("digest"))
    upto = Window.partitionBy("archive").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(upto)
    return one.select("archive", "number", (end - F.col("size")).alias("start"), end.alias("end"), "records", "digest")


_HEADER = re.compile(rb"(?i)^(warc-record-id|content-length)[ \t]*:[ \t]*(.*?)[ \t]*\r?$", re.MULTILINE)


def warc_records(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, id) of the records of a WARC file, blank lines between them included; what follows broken bytes is one record."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        named = dict((k.lower(), v) for k, v in _HEADER.findall(content[at:head])) if head >= 0 and content.startswith(b"WARC/", at) else {}
        length = named.get(b"content-length", b"")
        if not length.isdigit():
            yield at, len(content), ""
            return
        end = min(len(content), head + 4 + int(length))
        while content.startswith(b"\r\n", end):
            end += 2
        yield at, end, named.get(b"warc-record-id", b"").decode("utf-8", "replace")
        at = end


def warc_manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest of WARC files given as (path, content), uncompressed, and the records (archive, number, file, id, start, end).

    An archive is a file name, whatever folder a replica has it in; a record's place is given by its id.
    """
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in sized(batch["content"], 1, 1):
                path, content = (batch[c][at].as_py() for c in ("path", "content"))
                found = [(path, i, a, b, hashlib.sha256(content[a:b]).hexdigest()) for a, b, i in warc_records(content or b"")]
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                    pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "id", "start", "end", "digest"])

    found = files.select("path", "content").mapInArrow(read, "path string, id string, start long, end long, digest string")
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select(F.xxhash64(name).alias("archive"), F.pmod(F.xxhash64("id"), F.lit(PER_ARCHIVE)).alias("number"), name.alias("file"), "id", "start", "end",
                        (F.col("end") - F.col("start")).alias("size"), "digest")
    return placed(rows), rows.drop("size")


def tree(leaves: DataFrame, label: str, top: int = TOP) -> DataFrame:
    """Nodes (archive, level, node, size, digest) over ``leaves`` (archive, number, start, end, digest), written level by level to the
    shared folder; the roots have level ``top``."""
    spark = leaves.sparkSession
    path = shared_dir(spark, label)
    level = leaves.select("archive", F.col("number").alias("node"), (F.col("end") - F.col("start")).alias("size"), "digest")
    level.write.parquet(f"{path}/level=0")
    for n in range(1, top + 1):
        below = spark.read.schema(level.schema).parquet(f"{path}/level={n - 1}")
        child = F.struct(F.pmod("node", F.lit(FAN)).alias("place"), "size", "digest")
        parents = below.groupBy("archive", F.floor(F.col("node") / FAN).alias("node")).agg(
            F.sum("size").alias("size"), F.array_sort(F.collect_list(child)).alias("children"))
        parts = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["place"], c["size"], c["digest"])), ",")
        parents.select("archive", "node", "size", F.sha2(parts, 256).alias("digest")).write.parquet(f"{path}/level={n}")
    return spark.read.schema(level.withColumn("level", F.lit(0)).schema).option("basePath", path).parquet(path)


def audit(first: DataFrame, second: DataFrame, top: int = TOP) -> DataFrame:
    """(archive, number, status, first_digest, second_digest) of the places that differ: changed, missing or extra."""
    bad = None
    for level in range(top, -1, -1):
        sides = []
        for name, t in (("first", first), ("second", second)):
            nodes = t.where(F.col("level") == level).select("archive", "node", F.col("digest").alias(f"{name}_digest"))
            if bad is not None:  # only below what differs
                nodes = nodes.join(bad, (nodes.archive == bad.at) & (F.floor(nodes.node / FAN) == bad.above), "left_semi")
            sides.append(nodes)
        both = sides[0].join(sides[1], ["archive", "node"], "full").where(~F.col("first_digest").eqNullSafe(F.col("second_digest")))
        bad = both.select(F.col("archive").alias("at"), F.col("node").alias("above")) if level else both
    status = F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "extra").otherwise("changed")
    return bad.select("archive", F.col("node").alias("number"), status.alias("status"), "first_digest", "second_digest")
