"""Passages that earlier documents already have, found by suffix trees over words that are partitioned by prefix.

Every place of a text is a suffix. Leaves that hang above the wanted depth of ``k`` words tell nothing, so they are pruned
first: only suffixes whose first k words stand in two different texts, by a fingerprint, go on. The rest are dealt out by
their first words: by one word where few suffixes start with it, by two, four, eight or all k where more do, so that no
group is larger than its bound. A group sorted by its words is a subtree, read from left to right: neighbours that agree
in k words hang below one internal node of that depth, which is a repeat, and the first leaf is its earliest document.

A prefix of k words that is still too frequent needs no subtree: it is a node by itself, and its earliest document is
known from the counting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.llm import hashing as H
from khata.llm.frames import kept

K = 13
#: Windows of a bucket of fingerprints; least number of buckets.
BUCKET, BUCKETS = 4 << 20, 48
#: Suffixes of a group; but prefixes that get longer are so many at most.
GROUP, PREFIXES = 200_000, 100_000
#: Stands for a null id: later than all others.
LAST = 2**63 - 1


def windows(texts: H.Texts, k: int) -> tuple[H.Words, np.ndarray, np.ndarray]:
    """The words, the places where a whole window of k words starts, and the windows' fingerprints."""
    words = H.split_words(texts)
    at = np.flatnonzero(H.whole_runs(words, k))
    return words, at, H.run_hashes(H.span_hashes(texts.data, words.starts, words.ends), k)[at]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def packed_prints(h: np.ndarray, row: np.ndarray, contents: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, contents, counts, prints): the low halves of fingerprints by bucket, with how many each text has there.

    ``row`` is the ascending number of each fingerprint's text, ``contents`` are the texts' keys.
    """
    bucket = bucket_of(h, buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    row, low = row[order], (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out: list[list] = [[], [], [], []]
    for b in np.flatnonzero(np.diff(cuts)):
        r = row[cuts[b] : cuts[b + 1]]
        edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        counts = np.diff(np.append(edge, len(r))).astype(np.uint32)
        for column, value in zip(out, (int(b), contents[r[edge]].tobytes(), counts.tobytes(), low[cuts[b] : cuts[b + 1]].tobytes())):
            column.append(value)
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["bucket", "contents", "counts", "prints"])


PRINTS = "bucket int, contents binary, counts binary, prints binary"


def fingerprints(rows: DataFrame, k: int, buckets: int) -> DataFrame:
    """Fingerprints of all windows of the texts, packed by bucket for some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch["content"].to_numpy()
            for texts in H.slices(batch["text"]):
                words, at, h = windows(texts, k)
                yield packed_prints(h, words.row[at], contents[texts.first :], buckets)

    return rows.select("content", "text").mapInArrow(run, PRINTS)


def marked(marks: list[dict]) -> np.ndarray:
    """Bucket and low half of marked fingerprints as one number each."""
    return np.concatenate([np.frombuffer(m["prints"], np.uint32).astype(np.uint64) | np.uint64(m["bucket"] << 32) for m in marks])


def mark_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(h, buckets) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def repeated(prints: DataFrame) -> DataFrame:
    """(content, marks): for each text, the fingerprints that another text has too, as (bucket, prints) pairs."""

    def meet(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        joined = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
        content, low = np.repeat(joined("contents", np.int64), joined("counts", np.uint32)), joined("prints", np.uint32)
        order = np.argsort(low)
        start = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
        by = content[order]
        differ = np.minimum.reduceat(by, start) != np.maximum.reduceat(by, start)
        chosen = order[np.repeat(differ, np.diff(np.append(start, len(low))))]
        chosen = chosen[np.argsort(content[chosen], kind="stable")]
        content, low = content[chosen], low[chosen]
        edge = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]])) if len(content) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(content))
        return pa.table({"content": content[edge], "bucket": pa.array([bucket] * len(edge), pa.int32()), "prints": pa.array(
            [np.unique(low[a:b]).tobytes() for a, b in zip(edge, ends)], pa.binary())})

    found = prints.groupBy("bucket").applyInArrow(meet, "content long, bucket int, prints binary")
    return found.groupBy("content").agg(F.collect_list(F.struct("bucket", "prints")).alias("marks"))


def spotted(rows: DataFrame, marks: DataFrame, k: int, buckets: int) -> DataFrame:
    """(id, content, n_words, copy, text, spots, kept_sha256): places in each text where a repeat may start.

    The text is kept only where there are such places; elsewhere the digest of its words is final.
    """
    joined = rows.join(marks, "content", "left").select("id", "content", "copy", "text", "marks")
    schema = "id long, content long, copy boolean, n_words long, text string, spots binary, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in H.slices(batch["text"]):
                words, at, h = windows(texts, k)
                keys = mark_of(h, buckets)
                cuts = np.searchsorted(at, words.first)
                part = batch.slice(texts.first, len(texts.offsets) - 1)
                raw = texts.data.tobytes()
                copies, all_marks = part["copy"].to_pylist(), part["marks"].to_pylist()
                out: list[list] = [[], [], []]
                for i, (copy, given) in enumerate(zip(copies, all_marks)):
                    a, b = words.first[i], words.first[i + 1]
                    spots = np.zeros(0, np.int64)
                    if given and not copy:
                        spots = at[cuts[i] : cuts[i + 1]][np.isin(keys[cuts[i] : cuts[i + 1]], marked(given))] - a
                    gone = copy and b - a >= k
                    text = raw[texts.offsets[i] : texts.offsets[i + 1]]
                    out[0].append(text if len(spots) else None)
                    out[1].append(spots.astype(np.int32).tobytes() if len(spots) else None)
                    out[2].append(None if len(spots) else hashlib.sha256(b"" if gone else b" ".join(
                        [raw[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["content"], part["copy"], pa.array(np.diff(words.first), pa.int64()),
                     pa.array(out[0], pa.binary()).cast(pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())],
                    ["id", "content", "copy", "n_words", "text", "spots", "kept_sha256"])

    return joined.mapInArrow(run, schema)


def listed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """(id, content, words, spots) of every row."""
    for id_, content, text, spots in zip(*(batch[c].to_pylist() for c in ("id", "content", "text", "spots"))):
        raw = text.encode()
        words = H.split_words(H.Texts(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        yield id_, content, [raw[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist())], np.frombuffer(spots, np.int32)


class Plan:
    """Which prefixes are too frequent: by their number of words, and for those of k words the earliest document."""

    def __init__(self, k: int):
        self.lengths = [n for n in (1, 2, 4, 8) if n < k] + [k]
        self.longer: dict[int, set[bytes]] = {}
        self.nodes: dict[bytes, int] = {}

    def prefix(self, words: list[bytes], at: int) -> bytes | None:
        """The prefix whose group the suffix belongs to; none for a node that is known."""
        for n in self.lengths:
            p = b" ".join(words[at : at + n])
            if p not in self.longer.get(n, ()):
                return p
        return None


def planned(spots: DataFrame, k: int) -> Plan:
    """Counts prefixes, one length after the other, and only below those that are too frequent at the length before."""
    total = spots.agg(F.sum(F.octet_length("spots") / 4)).first()[0] or 0
    bound, plan = max(GROUP, total / PREFIXES), Plan(k)
    for i, n in enumerate(plan.lengths):
        above, m = (plan.longer.get(plan.lengths[i - 1]) if i else None), plan.lengths[i - 1]

        def count(batches, n=n, m=m, above=above):
            for batch in batches:
                seen: dict[bytes, list[int]] = {}
                for id_, _, words, at in listed(batch):
                    for p in at.tolist():
                        if above is None or b" ".join(words[p : p + m]) in above:
                            one = seen.setdefault(b" ".join(words[p : p + n]), [0, id_])
                            one[0] += 1
                            one[1] = min(one[1], id_)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                                  pa.array([v[1] for v in seen.values()], pa.int64())], ["prefix", "n", "first"])

        counts = spots.mapInArrow(count, "prefix binary, n long, first long").groupBy("prefix").agg(
            F.sum("n").alias("n"), F.min("first").alias("first"))
        rows = counts.where(F.col("n") > bound).collect()
        if not rows:
            break
        plan.longer[n] = {bytes(r["prefix"]) for r in rows}
        if n == k:
            plan.nodes = {bytes(r["prefix"]): r["first"] for r in rows}
    return plan


def later_leaves(spots: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(id, content, place): suffixes below a node of depth k whose earliest document is another one."""
    shared = spots.sparkSession.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for id_, content, words, at in listed(batch):
                for p in at.tolist():
                    suffix = b" ".join(words[p : p + k])
                    group = plan.prefix(words, p) if plan.longer else words[p]
                    if group is None:
                        if plan.nodes[suffix] >= id_:
                            continue
                        group = suffix = None  # decided already
                    for column, value in zip(out, (group, suffix, id_, content, p)):
                        column.append(value)
                if len(out[0]) > 50_000:
                    yield made(out)
                    out = [[], [], [], [], []]
            yield made(out)

    def made(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["prefix", "suffix", "id", "content", "place"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            known = pc.is_null(batch["suffix"])
            yield batch.filter(known).select(["id", "content", "place"])
            batch = batch.filter(pc.invert(known))
            if not len(batch):
                continue
            suffix, ids = batch["suffix"], batch["id"].to_numpy()
            new = np.ones(len(batch), bool)
            new[1:] = pc.not_equal(suffix[1:], suffix[:-1]).to_numpy(zero_copy_only=False)
            new[0] = suffix[0].as_py() != last
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            firsts = np.where(start >= 0, ids[np.maximum(start, 0)], first)
            last, first = suffix[len(suffix) - 1].as_py(), firsts[-1]
            yield batch.filter(pa.array(ids > firsts)).select(["id", "content", "place"])

    rows = spots.mapInArrow(deal, "prefix binary, suffix binary, id long, content long, place int")
    place = F.coalesce(F.xxhash64("prefix"), F.xxhash64("id", "place")).alias("part")
    dealt = rows.select(place, "suffix", "id", "content", "place").repartition("part").select("suffix", "id", "content", "place")
    return dealt.sortWithinPartitions("suffix", "id").mapInArrow(read, "id long, content long, place int")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(id, n_words, removed, n_removed, kept_sha256) for every row: what to remove, as spans of words, end exclusive.

    Removed is every word in a window of k words that also starts in a document of a smaller id. ``kept_sha256`` is the
    digest of the words that stay, joined by one space. Null texts have no words; a null id counts as later than all
    others. Rows that share an id are one document where ids are compared, but each has spans of its own. A text that an
    earlier document repeats as a whole goes whole, without being searched. Ids are integers; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, int(size / 6 / BUCKET))
    named = rows.select("id", "content", F.md5("text").alias("digest"))
    heads = named.groupBy("digest").agg(F.min("id").alias("head"))
    copies = kept(named.join(heads, "digest").where("id > head").select("id", "content").distinct(), "copies")
    flagged = rows.join(copies.withColumn("copy", F.lit(True)), ["id", "content"], "left").withColumn(
        "copy", F.coalesce("copy", F.lit(False)))
    marks = repeated(fingerprints(rows, k, buckets))
    seen = kept(spotted(flagged, marks, k, buckets), "spots")
    spots = seen.where("spots is not null").select("id", "content", "text", "spots")
    leaves = later_leaves(spots, planned(spots, k), k).groupBy("id", "content").agg(F.collect_set("place").alias("places"))
    joined = seen.join(leaves, ["id", "content"], "left").select("id", "n_words", "copy", "text", "places", "kept_sha256")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for n, copy, text, places, sha in zip(*(batch[c].to_pylist() for c in ("n_words", "copy", "text", "places", "kept_sha256"))):
                gone = np.zeros(n, bool)
                if copy and n >= k:
                    gone[:] = True
                elif text is not None:
                    gone = H.covered(np.array(places or [], np.int64), k, n)
                    raw = text.encode()
                    w = H.split_words(H.Texts(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
                    sha = hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(w.starts[~gone].tolist(), w.ends[~gone].tolist())])).hexdigest()
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out[0].append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])])
                out[1].append(int(gone.sum()))
                out[2].append(sha)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_words"], pa.array(out[0], arrow), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.string())], ["id", "n_words", "removed", "n_removed", "kept_sha256"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("removed", spans),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(run, schema).withColumn("id", F.nullif(F.col("id"), F.lit(LAST)))
