"""Spelling variants of a vocabulary: words one edit apart, found by dynamic programming along sorted lists.

A sorted list of words is scanned with one banded edit matrix per query word. A matrix row belongs to a prefix, so the next
word keeps the rows of what it shares with the word before (their LCP), and when a row has no cell within one edit, all
following words with that prefix are skipped.

Lists are kept short by where the edit is. For the class of lengths c (pairs of c and c, or of c and c + 1 code points) the
places of the first difference, 0 to c, are cut into intervals. Words that first differ in [a, b) share their first a and
their last c - b code points, which is the key of their list. A list that is longer than ``LONGEST`` is cut in two intervals,
down to one place, where the alphabet bounds it; no pair is lost, and none is found twice, as a pair counts only in the
interval that holds its first difference.

Nulls and empty texts have no words. A null id stands as empty text before the colon. Rows of one id are rows of their own.
Very long texts are read whole; a long word is one string. An empty table gives an empty vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.frames import kept

#: Runs of at least this many letters can be words. A word occurs twice or more.
LEAST_LENGTH, LEAST_COUNT = 7, 2
LETTERS = r"[A-Za-zÀ-ÿ]"
CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One run in this many loses a code point, as its hash decides.
DROPPED = 31
#: A form has this many times the occurrences of the word.
FACTOR = 10
#: Words of a list that is scanned without being cut further.
LONGEST = 128


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct words of all texts with their number of occurrences, at least ``LEAST_COUNT``.

    Counts are combined before they are shuffled, so a frequent word is a row per task.
    """
    runs = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.explode(
        F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"))).alias("run"))
    low = runs.select("key", F.translate("run", *CAPITALS).alias("run"))
    h = F.crc32(F.concat(F.coalesce("key", F.lit("")), F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    words = low.withColumn("h", h).select(F.when(F.col("h") % DROPPED == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key() -> Column:
    """Interval, shared start and shared end; the letters have no colon."""
    tail = F.greatest(F.col("c") - F.col("b"), F.lit(0))
    end = F.substr("word", F.length("word") - tail + 1, tail)
    return F.concat_ws(":", "c", "a", "b", F.substr("word", F.lit(1), F.col("a")), end)


def lists(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, c, a, b, word, n): every word in all its lists, none of which can be cut and has over ``longest`` words."""
    size = F.length("word")
    classes = F.explode(F.array(size, size - 1)).alias("c")
    half = F.floor(F.col("c") / 2).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("c") + 1).alias("b")))
    rows = words.select("word", "n", classes).select("word", "n", "c", F.inline(ends)).withColumn("key", _key())
    done = None
    while True:
        rows = kept(rows, "spelling-lists")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("c")).alias("short"))
        sizes = sizes.where("size > 1 and short > 0")  # others hold no pair
        cut = (F.col("size") > longest) & (F.col("b") - F.col("a") > 1)
        marked = kept(rows.join(sizes, "key").select(rows["*"], cut.alias("cut")), "spelling-sizes")
        ready = marked.where(~F.col("cut")).drop("cut")
        done = ready if done is None else done.union(ready)
        hot = marked.where("cut")
        if hot.isEmpty():
            return done
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))
        rows = hot.select("word", "n", "c", F.inline(halves)).withColumn("key", _key())


class Near(NamedTuple):
    """A word's near words of one list: how many, and the one of largest n (ties: the smallest)."""

    count: int
    n: int
    word: str


def _common(u: str, v: str) -> int:
    n = min(len(u), len(v))
    for i in range(n):
        if u[i] != v[i]:
            return i
    return n


def scan(words: list[str], queries: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs (query, other) of indexes into the sorted list ``words`` that are one edit apart.

    Row d of the matrix has the cells d - 1, d and d + 1 of the query: edits between the word's first d code points and so
    many of the query's. Cells outside of the query cost 2, as all do that no single edit reaches.
    """
    shared = [0, *(_common(u, v) for u, v in zip(words, words[1:], strict=False))]
    m = len(words)
    for q in queries:
        query = words[q]
        size = len(query)
        padded = "\0" + query + "\0\0\0"
        rows = [(2, 0, 1)]
        i = valid = 0
        while i < m:
            word = words[i]
            valid = min(valid, shared[i])
            d, last = valid, len(word)
            before, at, after = rows[d]
            while d < last:
                c = word[d]
                before, at, after = (min(before + (c != padded[d]), at + 1), min(at + (c != padded[d + 1]), after + 1),
                                     after + (c != padded[d + 2]))
                at = min(at, before + 1)
                after = min(after, at + 1)
                d += 1
                if d + 1 > size:
                    after = 2
                    if d > size:
                        at = 2
                        if d - 1 > size:
                            before = 2
                if before > 1 and at > 1 and after > 1:
                    break
                if d < len(rows):
                    rows[d] = (before, at, after)
                else:
                    rows.append((before, at, after))
            if before > 1 and at > 1 and after > 1:  # nothing with this prefix is near
                valid = d - 1
                i += 1
                while i < m and shared[i] >= d:
                    i += 1
                continue
            valid = d
            edits = {-1: before, 0: at, 1: after}.get(size - last, 2)
            if edits == 1 and i != q:
                yield q, i
            i += 1


def near_of(words: list[str], counts: list[int], c: int, a: int, b: int) -> dict[str, Near]:
    """Near words within a list. Words that differ in its front part are scanned from their ends."""
    turn = (lambda w: w[::-1]) if a == 0 else (lambda w: w)
    entries = sorted((turn(w), n) for w, n in zip(words, counts, strict=True))
    texts = [w for w, _ in entries]
    found: dict[str, Near] = {}

    def add(i: int, j: int) -> None:
        word, other, n = turn(texts[i]), turn(texts[j]), entries[j][1]
        old = found.get(word, Near(0, 0, ""))
        better = n > old.n or n == old.n and other < old.word
        found[word] = Near(old.count + 1, *((n, other) if better else (old.n, old.word)))

    for i, j in scan(texts, [k for k, w in enumerate(texts) if len(w) == c]):
        if a <= _common(turn(texts[i]), turn(texts[j])) < b:
            add(i, j)
            if len(texts[j]) != c:
                add(j, i)
    return found


PARTIAL = "word string, near long, best_n long, best string"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists stand one after the other, in any batches."""
    key, held = None, ([], [])
    out: list[tuple[str, int, int, str]] = []

    def close() -> None:
        if key is not None and len(held[0]) > 1:
            c, a, b = map(int, key.split(":", 3)[:3])
            out.extend((w, f.count, f.n, f.word) for w, f in near_of(*held, c, a, b).items())

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["word", "near", "best_n", "best"])

    for rows in batches:
        for k, word, n in zip(*(rows.column(x).to_pylist() for x in ("key", "word", "n")), strict=True):
            if k != key:
                close()
                key, held = k, ([], [])
            held[0].append(word)
            held[1].append(n)
        if len(out) >= 10_000:
            yield batch()
            out.clear()
    close()
    yield batch()


def variants(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, n, near, best, best_n) of every row (word, n) of a vocabulary: how many words are one edit away, and the one
    of them with the largest n (ties: the smallest by code points); 0 and nulls if there is none."""
    dealt = lists(words, longest).select("key", "word", "n").repartition("key").sortWithinPartitions("key")
    partial = dealt.mapInArrow(_scan_batches, PARTIAL)
    best = partial.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    chosen = best.select("word", "near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))
    return words.join(chosen, "word", "left").withColumn("near", F.coalesce("near", F.lit(0)))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of every row (word, form): where following forms ends. Each round doubles the steps made."""
    steps = kept(forms, "spelling-forms").select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = kept(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "spelling-roots")
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return steps


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    The form is the near word of largest n where that is at least ``FACTOR`` times the word's. Following forms, n grows by
    that factor with each step, so there are no circles and few steps.
    """
    words = kept(vocabulary(docs, key, text), "spelling-words")
    is_form = F.col("best_n") >= FACTOR * F.col("n")
    near = kept(variants(words).select("word", "n", F.col("near").alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                                       F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-near")
    roots = rooted(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
