"""Near-duplicate texts: links between sets of word n-grams of a given Jaccard similarity, and their components.

1. A set can only have a link if the required share of its n-grams stands in other sets too. Which do is found by
   fingerprints, all over the corpus; sets with too few are out.
2. Signatures bring likely partners together. Sets of like size are cut into hash ranges, one more than two linked sets
   can have differences (and some more, so that empty ranges need not count), so linked sets agree in a whole range that is
   not empty. N-grams that no other set has, or very many, are left out of this step; a linked pair has no more differences
   without them. Texts that agree in a range form candidate clusters.
3. A T-occurrence search runs within each cluster. It keeps an inverted index of the sets. For a set, its longest lists are
   put aside; the others are merged and counted; texts that can still reach the required overlap are probed for in the
   long lists by binary search (DivideSkip), and those that reach it are linked. A large cluster is cut into blocks, and
   the search runs for each pair of blocks.

A link within a component that is already known is not written, so a cluster of m texts gives less than m links a task,
not all pairs. Equal sets are one set from step 2 on. Sets are of 64-bit fingerprints of the n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.llm import hashing as H
from khata.llm import substrings
from khata.llm.frames import connected, kept, packed

#: Counters of the sketch that tells very frequent n-grams, and the pieces it is added up in.
COUNTERS, PIECES = 1 << 19, 64
#: Frequent: more than twice the mean counter and this.
FREQUENT = 100
#: Ranges beyond differences + 1: these, and this share of the others.
SPARE, SPARE_SHARE = 2, 4
#: N-grams of a bucket of fingerprints.
BUCKETS = 48
#: Texts of a slice, which are numbered in 16 bits.
SLICE_TEXTS = 1 << 16
PRINTS = "slice long, bucket int, texts binary, counts binary, prints binary"
SLICED = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("texts", pa.binary()), ("counts", pa.binary()), ("prints", pa.binary())])
#: Texts and n-grams of a block of a large cluster.
BLOCK_TEXTS, BLOCK_GRAMS = 400, 1 << 19
#: Weight of the logarithm in DivideSkip's number of long lists.
MU = 0.01


class Likeness(NamedTuple):
    """N-grams of ``words`` words; linked when ``whole`` * intersection >= ``part`` * union."""

    words: int = 5
    part: int = 80
    whole: int = 100

    def classes(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First size of every size class up to ``largest``, the ranges that its sets are cut into (0: equal sets only), and
        how many of those may be empty.

        The partner of a set, if larger, is in the same class or the next one.
        """
        first, ranges, spare, low = [], [], [], 1
        while low <= largest:
            high = low * self.whole // self.part
            most = (high + high * self.whole // self.part) * (self.whole - self.part) // (self.whole + self.part)
            first.append(low)
            spare.append(SPARE + (most + 1) // SPARE_SHARE)
            ranges.append(most + 1 + spare[-1] if most else 0)
            low = high + 1
        return np.array(first), np.array(ranges), np.array(spare)


def gram_sets(texts: H.Texts, k: int) -> list[np.ndarray]:
    """The sorted distinct n-grams of every row. A row of fewer words has its whole sequence as one; one without, none."""
    data = H.LOWER[texts.data]
    words = H.split_words(texts)
    hashes = H.span_hashes(data, words.starts, words.ends)
    runs, count = H.run_hashes(hashes, k), np.diff(words.first)
    out = [np.unique(runs[a : max(a, b - k + 1)]) for a, b in zip(words.first[:-1], words.first[1:])]
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            whole = H.mix(H.run_hashes(hashes, m)[words.first[short]] + np.uint64(m))
            for i, h in zip(short, whole):
                out[i] = np.array([h])
    return out


def each_set(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for texts in H.slices(batch["text"]):
            yield batch["id"].slice(texts.first, len(texts.offsets) - 1), gram_sets(texts, k)


def digest_of(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def content_of(digest: bytes | None) -> int | None:
    """Half of a set's digest as a number, under which its n-grams go."""
    return int.from_bytes(digest[:8], "little", signed=True) if digest else None


def measured(docs: DataFrame, like: Likeness) -> DataFrame:
    """(id, n, digest, content) of every row: size of its set, 128 bits of it and 64 of those (null for an empty one)."""

    def run(batches):
        for ids, sets in each_set(batches, like.words):
            digests = [digest_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array([content_of(d) for d in digests], pa.int64())], ["id", "n", "digest", "content"])

    return docs.mapInArrow(run, "id long, n long, digest binary, content long")


def prints_of(docs: DataFrame, like: Likeness, buckets: int) -> DataFrame:
    """Fingerprints of the n-grams of all sets, packed by bucket for a slice of some texts at a time.

    A text goes by its number in the slice, so what a fingerprint takes does not grow with the buckets. What the numbers
    stand for (ids, contents, sizes) is one row for each slice, in a bucket beyond the others.
    """

    def run(batches):
        for ids, sets in each_set(batches, like.words):
            full = np.flatnonzero([len(s) > 0 for s in sets])
            for at in range(0, len(full), SLICE_TEXTS):
                some = full[at : at + SLICE_TEXTS]
                own = [sets[i] for i in some]
                sizes = [len(s) for s in own]
                names = np.array([ids.to_numpy()[some], [content_of(digest_of(s)) for s in own], sizes], np.int64).tobytes()
                key = int.from_bytes(hashlib.blake2b(names, digest_size=8).digest(), "little", signed=True)
                packed = substrings.packed_prints(np.concatenate(own), np.repeat(np.arange(len(own)), sizes),
                                                  np.arange(len(own), dtype=np.uint16), buckets)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(packed), pa.int64()), *packed.columns], SLICED.names)
                yield pa.RecordBatch.from_pylist([{"slice": key, "bucket": buckets + key % buckets, "texts": names, "counts": b"", "prints": b""}], SLICED)

    return docs.select("id", "text").mapInArrow(run, PRINTS)


def shared_of(prints: DataFrame, like: Likeness, buckets: int) -> DataFrame:
    """(id, content, n, marks) of every row of which enough fingerprints stand in another row too, with those.

    Copies of a text count as other rows here. A bucket is a group, and then a slice is.
    """

    def meet(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        if bucket >= buckets:
            return group
        joined = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
        part = np.repeat(np.arange(len(group)), [len(t) // 2 for t in group["texts"].to_pylist()])
        text, low = np.repeat(part << 16 | joined("texts", np.uint16), joined("counts", np.uint32)), joined("prints", np.uint32)
        order = np.argsort(low)
        start = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
        by = text[order]
        differ = np.minimum.reduceat(by, start) != np.maximum.reduceat(by, start)
        chosen = np.sort(order[np.repeat(differ, np.diff(np.append(start, len(low))))])
        text, low = text[chosen], low[chosen]
        ends = np.append(np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])), len(text)) if len(text) else np.zeros(1, np.int64)
        owner = text[ends[:-1]]
        cuts = np.searchsorted(owner >> 16, np.arange(len(group) + 1))
        out: list[dict] = []
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[i], cuts[i + 1]
            out.append({"slice": group["slice"][int(i)].as_py(), "bucket": bucket, "texts": (owner[a:b] & 0xFFFF).astype(np.uint16).tobytes(),
                        "counts": np.diff(ends[a : b + 1]).astype(np.uint32).tobytes(), "prints": low[ends[a] : ends[b]].tobytes()})
        return pa.Table.from_pylist(out, SLICED)

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        names = next((r["texts"] for r in rows if r["bucket"] >= buckets), None)
        if names is None:
            raise RuntimeError("the texts came in another order when a lost task ran again: write them to files first")
        ids, contents, sizes = np.frombuffer(names, np.int64).reshape(3, -1)
        rows = [r for r in rows if r["bucket"] < buckets]
        text = np.concatenate([np.zeros(0, np.uint16), *[np.repeat(np.frombuffer(r["texts"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in rows]])
        mark = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["prints"], np.uint32) | np.uint64(r["bucket"] << 32) for r in rows]])
        order = np.argsort(text, kind="stable")
        mark, cuts = mark[order], np.searchsorted(text[order], np.arange(len(ids) + 1))
        has = np.flatnonzero(like.whole * np.diff(cuts) >= like.part * sizes)
        return pa.table({"id": ids[has], "content": contents[has], "n": sizes[has],
                         "marks": pa.array([mark[cuts[i] : cuts[i + 1]].tobytes() for i in has], pa.binary())})

    found = prints.groupBy("bucket").applyInArrow(meet, PRINTS)
    return found.groupBy("slice").applyInArrow(gather, "id long, content long, n long, marks binary")


def frequent(members: DataFrame, like: Likeness) -> np.ndarray:
    """Which counters hold very frequent n-grams: counted over all members, once per text. A table of fixed size."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, sets in each_set(batches, like.words):
            if sets:
                total += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        rows = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(PIECES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                                         ["piece", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist()):
                total[piece] = total.get(piece, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
                                         ["piece", "counts"])

    rows = members.select("id", "text").mapInArrow(count, "piece int, counts binary").repartition(PIECES, "piece").mapInArrow(
        add, "piece int, counts binary")
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows.collect(), key=lambda r: r["piece"])]
                            or [np.zeros(COUNTERS, np.int64)])
    return counts > 2 * counts.mean() + FREQUENT


def signatures(sets: list[np.ndarray], shared: list[np.ndarray], like: Likeness, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): one for each range of each set, for its size class and the one below. Of a set, ``shared`` holds
    what other sets have too; of that the ``hot`` n-grams are left out."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, ranges, spare = like.classes(int(sizes.max()))
    cold = [s[~hot[(s % np.uint64(COUNTERS)).astype(np.int64)]] for s in shared]
    grams, own = np.concatenate(cold), np.repeat(np.arange(len(sets)), [len(c) for c in cold])
    rows, found = [], []
    for below in (0, 1):
        kind = np.searchsorted(first, sizes, "right") - 1 - below
        cut = np.where(kind >= 0, ranges[np.maximum(kind, 0)], 0)  # ranges of each row, 0: none
        live = cut[own] > 0
        g, row = grams[live], own[live]
        part = ((g >> np.uint64(32)) * cut[row].astype(np.uint64)) >> np.uint64(32)
        tag = H.mix((kind.astype(np.uint64) << np.uint64(32))[row] + part)
        edge = np.ones(len(g), bool)
        edge[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(edge)
        if len(at):
            rows.append(row[at])
            found.append(H.mix(np.add.reduceat(H.mix(g + np.uint64(1)), at) ^ tag[at]))
        used = np.bincount(row[at], minlength=len(sets))
        for i in np.flatnonzero((cut > 0) & (cut - used > spare[np.maximum(kind, 0)])):  # so many empty ranges that they have to count
            empty = np.setdiff1d(np.arange(cut[i], dtype=np.uint64), part[row == i])
            rows.append(np.full(len(empty), i))
            found.append(H.mix((np.uint64(kind[i]) << np.uint64(32)) + empty + np.uint64(1 << 63)))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def likely(members: DataFrame, like: Likeness, buckets: int) -> DataFrame:
    """Edges (a, b) between ``members`` (id, text, marks) that agree in a signature, each with the first one that has it."""
    hot = np.packbits(frequent(members, like)).tobytes()

    def sign(batches):
        bits = np.unpackbits(np.frombuffer(hot, np.uint8)).astype(bool)
        for batch in batches:
            for texts in H.slices(batch["text"]):
                part = batch.slice(texts.first, len(texts.offsets) - 1)
                sets = gram_sets(texts, like.words)
                shared = [s[np.isin(substrings.mark_of(s, buckets), np.frombuffer(b"".join(m), np.uint64))] for s, m in zip(sets, part["marks"].to_pylist())]
                row, found = signatures(sets, shared, like, bits)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), part["id"].take(pa.array(row))], ["signature", "id"])

    def meet(batches):
        """Rows come sorted, so the texts of a signature pass one by one."""
        last, head = None, None
        for batch in batches:
            sign, ids = batch["signature"].to_numpy(), batch["id"].to_numpy()
            if not len(sign):
                continue
            new = np.ones(len(sign), bool)
            new[1:] = sign[1:] != sign[:-1]
            new[0] = sign[0] != last
            start = np.maximum.accumulate(np.where(new, np.arange(len(sign)), -1))
            heads = np.where(start >= 0, ids[np.maximum(start, 0)], head if head is not None else 0)
            last, head = sign[-1], heads[-1]
            pairs = np.unique(np.stack([ids, heads], axis=1)[ids != heads], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = members.select("id", "text", "marks").mapInArrow(sign, "signature long, id long")
    return rows.repartition("signature").sortWithinPartitions("signature", "id").mapInArrow(meet, "a long, b long").distinct()


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def t_occurrence(sets: list[np.ndarray], block: np.ndarray, like: Likeness) -> list[tuple[int, int]]:
    """Links between the sets (of two blocks: across them) that join components, by DivideSkip over an inverted index."""
    n = np.array([len(s) for s in sets])
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(code, kind="stable")
    lists, ends = owner[order], np.cumsum(np.bincount(code, minlength=len(tokens)))
    begins, across = np.concatenate([[0], ends[:-1]]), block.min() != block.max()
    at, forest, links = np.concatenate([[0], np.cumsum(n)]), Forest(len(sets)), []
    for x in range(1, len(sets)):
        mine = code[at[x] : at[x + 1]]
        length = ends[mine] - begins[mine]
        mine, length = (v[np.argsort(length)] for v in (mine, length))
        need = -(-like.part * int(n[x]) // like.whole)  # an overlap below this share of either set is too small
        long = min(len(mine) - 1, int(need / (MU * np.log2(max(2, length[-1])) + 1)), need - 1)
        short = mine[: len(mine) - long]
        steps = ends[short] - begins[short]
        shift = np.repeat(begins[short] - np.concatenate([[0], np.cumsum(steps)[:-1]]), steps)
        counts = np.bincount(lists[np.arange(len(shift)) + shift], minlength=len(sets))
        ok = counts[:x] >= need - long
        if across:
            ok &= block[:x] != block[x]
        able = np.flatnonzero(ok)
        able = able[(like.whole * n[able] >= like.part * n[x]) & (like.whole * n[x] >= like.part * n[able])]
        if not len(able):
            continue
        shared = counts[able]
        for t in mine[len(mine) - long :]:
            listed = lists[begins[t] : ends[t]]
            place = np.minimum(np.searchsorted(listed, able), len(listed) - 1)
            shared = shared + (listed[place] == able)
        for y in able[like.whole * shared >= like.part * (n[x] + n[able] - shared)]:
            a, b = forest.root(x), forest.root(int(y))
            if a != b:
                forest.up[a] = b
                links.append((x, int(y)))
    return links


def links_within(rows: DataFrame, clusters: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between ``rows`` (id, text) of one of the ``clusters`` (id, cluster, size): one group per pair of blocks.

    Blocks are laid out without the texts, which move once to meet their places and once to their groups. Places grow
    with the corpus, so they are never broadcast.
    """
    sums = clusters.groupBy("cluster").agg(F.count("*").alias("texts"), F.sum("size").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    places = clusters.join(sums.select("cluster", blocks.alias("blocks")), "cluster").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    places = places.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    paired = rows.join(places.hint("merge"), "id")

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        sets = [s for texts in H.slices(group["text"]) for s in gram_sets(texts, like.words)]
        ids = group["id"].to_numpy()
        found = np.array(t_occurrence(sets, group["block"].to_numpy(), like), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    # small in bytes and costly per byte: one partition per task, not as many as fit a size
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(tasks, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(search, "a long, b long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """(id, n, component) for every row: size of its set, and the smallest id that links lead to (its own without any).

    A text without words, an empty one or a null one has an empty set and no links. Rows that share an id are one node and
    linked by what any of them holds. Rows with a null id are linked with nothing; their component is null. Ids are
    integers. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sizes = kept(measured(rows, like), "sets")
    named = sizes.where("digest is not null and id is not null")
    heads = named.groupBy("digest").agg(F.min("id").alias("head"))
    same = kept(named.join(heads, "digest").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "heads")
    # one row for each set: the sets that share enough, with what they share
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, int(size / 6 / substrings.BUCKET))
    found = shared_of(prints_of(rows.where("id is not null"), like, buckets), like, buckets)
    first = named.join(heads, "digest").where("id = head").select("id", F.col("content").alias("own")).distinct()
    able = first.join(found, "id").where("content = own")
    # written before texts move, so that they never lie on disk beside the fingerprints
    able = kept(able.groupBy("id").agg(F.max("n").alias("n"), F.collect_list("marks").alias("marks")), "able")  # one text an id, as a rule
    members = kept(rows.join(able.hint("merge"), "id"), "members")
    clusters = kept(connected(likely(members, like, buckets), "clusters"), "clusters")
    placed = clusters.join(members.groupBy("id").agg(F.sum("n").alias("size")), "id").select("id", F.col("component").alias("cluster"), "size")
    reached = connected(links_within(members.select("id", "text"), placed, like).union(same), "components")
    return sizes.select("id", "n").join(reached, "id", "left").select(
        "id", "n", F.coalesce("component", "id").alias("component"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.

    Rows of one id are one document, of which the row with words and the smallest digest stays. Of rows with a null id one
    stays for each text.
    """
    number, body = F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = lambda i: F.concat(F.lit("="), i.cast("string"))
    one = F.coalesce(name(number), F.sha2(body, 256)).alias("one")
    others = kept(join(docs, key, text, like).where("id <> component").select(name(F.col("id")).alias("one")).distinct(), "others")
    # few as a rule, and known before texts are moved for them
    repeated = kept(docs.select(one).groupBy("one").agg(F.count("*").alias("n")).where("n > 1").select("one").join(others, "one", "left_anti"), "repeated")
    rows = packed(docs, one=one, blank=~body.rlike(r"[^\x20\x09-\x0D]"), digest=F.sha2(body, 256))
    several = rows.join(repeated, "one", "left_semi").groupBy("one").agg(F.min_by("row", F.struct("blank", "digest")).alias("row"))
    # what goes and what is repeated leave in one join, so that texts move once
    return rows.join(others.union(repeated), "one", "left_anti").select("row").union(several.select("row")).select("row.*")
