"""Benchmark passages in texts, found by the q-gram lemma and verified by banded alignment.

An item of n bytes that stands in a text with at most e edits shares at least n - q + 1 - q * e of its q-grams with it, on
diagonals (place in the text less place in the item) that lie at most e apart. So shared q-grams are counted by item and
diagonal band; bands overlap by e, so one of them holds all. Bands that reach the bound are aligned within the band.

Texts and items are compared in lower case with single blanks between words; places are those of that form, in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.llm.frames import packed, release, schema_with, sized

Q = 8
#: Edits allowed, as a share of an item's bytes.
RATE = 0.1
#: Bytes of text handled at a time, of items in one pass over the texts, and bits of the table that is asked first.
PIECE, ITEM_BYTES, BITS = 2 << 20, 4 << 20, 22
#: Alignments that run side by side, and cells of a row of them; places of grams that are counted at a time.
ALIGNED, CELLS, PLACES = 256, 1 << 20, 1 << 20
#: Bytes of texts that are searched before they are handed on.
BATCH_BYTES = 4 << 20


def plain(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each place as one 64-bit number: eight bytes, so equal numbers are equal grams."""
    v = data.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    return v


def slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Found(NamedTuple):
    row: int
    item: int
    start: int
    end: int
    edits: int


class Items:
    """q-grams of the items, sorted, and their bounds. Items shorter than q bytes are looked for as they are, as whole words."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.short: dict[bytes, list[int]] = {}
        for i, b in items:
            if b and len(b) < Q:
                self.short.setdefault(b, []).append(i)
        either = b"|".join(re.escape(b) for b in sorted(self.short))
        # a look ahead, so that items may overlap
        self.any_short = re.compile(rb"(?<![\w\x80-\xff])(?=(" + either + rb")(?![\w\x80-\xff]))") if self.short else None
        items = [(i, b) for i, b in items if len(b) >= Q]
        self.ids = [i for i, _ in items]
        self.bytes = [np.frombuffer(b, np.uint8) for _, b in items]
        self.n = np.array([len(b) for _, b in items], np.int64)
        # no more edits than leave one gram that has to be shared
        self.edits = np.minimum((rate * self.n).astype(np.int64), np.maximum(0, (self.n - Q) // Q))
        self.least = self.n - Q + 1 - Q * self.edits
        each = [grams(b) for b in self.bytes]
        g = np.concatenate(each) if each else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.item = np.repeat(np.arange(len(each)), [len(x) for x in each])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in each])[order] if each else np.zeros(0, np.int64)
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[slot(self.grams)] = True
        self.reach = int((self.n + 2 * self.edits).max(initial=0))

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first diagonal, last diagonal) of the bands of ``data`` that reach their item's bound."""
        none = np.zeros(0, np.int64)
        if len(data) < Q or not len(self.grams):
            return none, none, none
        g = grams(data)
        at = np.flatnonzero(self.maybe[slot(g)])
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        real = self.grams[k] == g[at]
        at, k = at[real], k[real]
        times = self.count[k]
        ends, keys, hits, lo = np.cumsum(times), [], [], 0
        while lo < len(at):  # a common gram has many places; bands are counted from so many at a time
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - times[lo] + PLACES, "right")))
            key, n = self._bands(at[lo:hi], k[lo:hi])
            keys.append(key)
            hits.append(n)
            lo = hi
            if len(keys) > 1 and (sum(map(len, keys)) > PLACES or lo == len(at)):
                key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                keys, hits = [key], [np.bincount(inverse, np.concatenate(hits)).astype(np.int64)]
        if not keys:
            return none, none, none
        key, hits = keys[0], hits[0]
        item, band = key >> 40, key & ((1 << 40) - 1)
        good = hits >= self.least[item]
        item, band = item[good], band[good]
        step = 2 * self.edits[item] + 8
        low = band * step - self.reach
        return item, low, low + step + self.edits[item]

    def _bands(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item and band as one number, shared grams) for the grams ``k`` at the places ``at``."""
        times = self.count[k]
        each = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item = self.item[each]
        diagonal = np.repeat(at, times) - self.place[each] + self.reach  # never negative
        step = 2 * self.edits[item] + 8
        band = diagonal // step
        # a band goes on for e diagonals beyond its step, so a hit near the start is also in the band before
        early = (diagonal % step <= self.edits[item]) & (band > 0)
        item, band = np.concatenate([item, item[early]]), np.concatenate([band, band[early] - 1])
        return np.unique(item << 40 | band, return_counts=True)

    def align(self, data: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(number of the candidate, start, end, edits) of those that align within their band and budget.

        ``gaps`` marks the bytes between texts, which no alignment starts at or takes in: a gap is longer than any item may
        spend on bytes that it lacks, so what aligns starts and ends in one text.

        Column j of row i is the item's first i bytes against the text up to diagonal low + j; the start is free. The row's
        own insertions are a running minimum. Starts travel along with the edits, as the low part of one number.
        """
        order = np.argsort(self.n[item], kind="stable")
        # by length, so that neighbours have bands of like width
        wide, a = (high - low)[order] + 1, 0
        while a < len(order):
            together = int((np.maximum.accumulate(wide[a : a + ALIGNED]) * np.arange(1, len(wide[a : a + ALIGNED]) + 1) <= CELLS).sum())
            part = order[a : a + max(1, together)]
            a += len(part)
            n, lo = self.n[item[part]], low[part]
            width = int((high - low)[part].max()) + 1
            longest = int(n.max())
            pattern = np.zeros((len(part), longest), np.uint8)
            for i, c in enumerate(part):
                pattern[i, : n[i]] = self.bytes[item[c]]
            padded = np.concatenate([np.zeros(longest + width, np.uint8), data, np.zeros(longest + 2 * width, np.uint8)])
            between = np.concatenate([np.zeros(longest + width, bool), gaps, np.zeros(longest + 2 * width, bool)])
            columns = np.arange(width)
            one, far = 1 << 32, 1 << 50
            outside = (lo[:, None] + columns < 0) | (lo[:, None] + columns > len(data))
            outside |= between[(lo + longest + width)[:, None] + columns]
            cost = np.where(outside, far, columns[None, :])  # edits * 2**32 + column of the start
            best = np.full((len(part), width), far)
            for i in range(1, longest + 1):
                byte = (lo + i - 1 + longest + width)[:, None] + columns
                text, barred = padded[byte], between[byte]
                place = lo[:, None] + columns + i  # end in the text
                same = (text == pattern[:, i - 1 : i]) & (place > 0) & (place <= len(data))
                down = np.full_like(cost, far)
                down[:, :-1] = cost[:, 1:] + one  # a byte of the item that the text lacks
                now = np.where(barred, down, np.minimum(cost + one * ~same, down))
                now = np.where(barred, down, np.minimum.accumulate(now - one * columns, axis=1) + one * columns)
                now[(place < 0) | (place > len(data))] = far
                cost = now
                done = n == i
                best[done] = cost[done]
            edits, start = best >> 32, best & (one - 1)
            column = edits.argmin(axis=1)
            for i, c in enumerate(part):
                j = int(column[i])
                if edits[i, j] <= self.edits[item[c]]:
                    yield int(c), int(lo[i] + start[i, j]), int(lo[i] + n[i] + j), int(edits[i, j])

    def search(self, texts: list[bytes]) -> Iterator[Found]:
        """The best place of each item in each text that holds it, texts strung together up to ``PIECE`` bytes."""
        parts: list[tuple[int, int, bytes]] = []  # row, offset in its text, bytes
        best: dict[tuple[int, int], Found] = {}  # over all pieces of a text
        size = 0
        for row, text in enumerate(texts):
            step = PIECE - self.reach if self.reach < PIECE // 2 else PIECE
            cuts = range(0, max(1, len(text) - self.reach), step) if len(text) > PIECE else [0]
            for at in cuts:  # neighbouring parts share what an item may span
                piece = text[at : at + step + self.reach] if len(text) > PIECE else text
                if size + len(piece) > PIECE and parts:
                    self._search(parts, best)
                    parts, size = [], 0
                parts.append((row, at, piece))
                size += len(piece) + 1
        if parts:
            self._search(parts, best)
        yield from best.values()
        if self.any_short:
            for row, text in enumerate(texts):
                seen = set()
                for m in self.any_short.finditer(text):
                    if m.group(1) not in seen:
                        seen.add(m.group(1))
                        yield from (Found(row, i, m.start(), m.start() + len(m.group(1)), 0) for i in self.short[m.group(1)])

    def _search(self, parts: list[tuple[int, int, bytes]], best: dict[tuple[int, int], Found]) -> None:
        gap = int(self.edits.max(initial=0)) + 1  # more than any item may spend, so nothing aligns across texts
        data = np.frombuffer((b"\0" * gap).join(p[2] for p in parts), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(p[2]) + gap for p in parts])])
        gaps = np.ones(len(data), bool)
        for at, (_, _, piece) in zip(begin, parts):
            gaps[at : at + len(piece)] = False
        for c, start, end, edits, item in ((*a, int(self_item)) for a, self_item in self._aligned(data, gaps)):
            at = int(np.searchsorted(begin, start, "right")) - 1
            row, offset, _ = parts[at]
            found = Found(row, self.ids[item], start - int(begin[at]) + offset, end - int(begin[at]) + offset, edits)
            old = best.get((row, item))
            if old is None or (edits, found.start) < (old.edits, old.start):
                best[row, item] = found

    def _aligned(self, data: np.ndarray, gaps: np.ndarray):
        item, low, high = self.candidates(data)
        for found in self.align(data, item, low, high, gaps):
            yield found, item[found[0]]


def items_in_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of some ``ITEM_BYTES``, each small enough to be sent to every task."""
    items = benchmark.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // ITEM_BYTES)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        yield [(r["id"], plain(r["text"])) for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          rate: float = RATE) -> DataFrame:
    """(row, leaks): every row as a struct, with the benchmark items that stand in its text.

    Leaks are structs (item, start, end, edits), the best place of each item, by item and start. Row by row over whole
    texts, without a shuffle; a benchmark of more than one block is searched for block after block. Null and empty texts
    have no leaks, and null and empty items do not leak. Items of less than ``Q`` bytes leak where they stand as they are, as
    whole words. Of repeated items each leaks by itself.
    """
    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item", "start", "end", "edits")]))
    rows = packed(docs, text=F.col(f"`{text}`"))
    schema = schema_with(rows.select("row"), ("leaks", kind))
    arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("item", "start", "end", "edits")]))
    blocks = [docs.sparkSession.sparkContext.broadcast(items) for items in items_in_blocks(benchmark, item_key, item_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Items(blocks[0].value, rate) if len(blocks) == 1 else None
        for whole in batches:
            for at, n in sized(whole["text"], BATCH_BYTES, len(whole)):
                batch = whole.slice(at, n)
                texts, found = [plain(t.as_py()) for t in batch["text"]], [[] for _ in range(n)]
                for block in blocks:
                    for f in (only or Items(block.value, rate)).search(texts):
                        found[f.row].append((f.item, f.start, f.end, f.edits))
                rows = [[dict(zip(("item", "start", "end", "edits"), f, strict=True)) for f in fs] for fs in found]
                yield pa.RecordBatch.from_arrays([batch["row"], pa.array(rows, arrow)], schema.fieldNames())
        release()

    return rows.mapInArrow(run, schema).select("row", F.array_sort("leaks").alias("leaks"))
