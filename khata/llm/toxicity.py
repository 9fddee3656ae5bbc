"""Toxic texts by a learned lexicon, met exactly or misspelled, and the words around each hit.

The lexicon's terms, whole words and word stems, stand in a trie. A Levenshtein automaton runs along it: a state is a set
of (trie node, edits so far), and states are made deterministic as they are first reached, so a word costs one lookup per
character. A hit inside quotation marks or after a reporting word counts as quoted, any other as abuse. A logistic
regression turns the counts into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.llm.frames import kept, packed, schema_with

#: At most so many labelled documents are learned from: those whose ids have the smallest hashes.
SAMPLE = 30_000
#: A term must stand after so many different words in toxic documents (copies of one text count once), or after this
#: share of their number, be so many times as frequent in toxic documents as in others, and deviate from the base rate by
#: this log-likelihood ratio.
LEAST_CONTEXTS, CONTEXT_SHARE, LIFT, LEAST_RATIO = 4, 0.003, 10.0, 20.0
STEMS = range(4, 9)
#: A score from which a text is called toxic.
THRESHOLD = 0.3
WORD = re.compile(r"[^\W_]+")
REPORTING = frozenset("""said says say called calls wrote writes quote quoted quotes quoting word words term terms
sagte sagt nannte schrieb zitat wort dit disait appela mot citation dijo dice llamó palabra cita""".split())
#: Characters beside a hit in which quotation marks are looked for, and words before it that may report.
NEAR, BEFORE = 80, 4
PAIRS = [("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’")]
EXACT, FUZZY = 1, 2


def budget(term: str, stem: bool) -> int:
    """Edits allowed in a term."""
    n = len(term) - 2 * stem
    return 0 if n < 5 else 1 if n < 9 else 2


class Lexicon:
    """Levenshtein automaton over the trie of the terms; ``find(word)`` is 0, EXACT or FUZZY."""

    #: States that are kept; beyond these they are made anew, so memory stays bounded.
    MOST_STATES = 100_000

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.budget, self.word_end, self.stem_end = [0], [-1], [-1]
        for term, stem in sorted(terms):
            node, most = 0, budget(term, stem)
            self.budget[0] = max(self.budget[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for row, value in ((self.budget, 0), (self.word_end, -1), (self.stem_end, -1)):
                        row.append(value)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], most)
            ends = self.stem_end if stem else self.word_end
            ends[node] = most
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.stops: list[int] = []
        self._state(self._closed({0: 0}))

    def _closed(self, now: dict[int, int]) -> tuple:
        """With the nodes that deletions reach."""
        todo = list(now)
        while todo:
            node = todo.pop()
            e = now[node] + 1
            for child in self.children[node].values():
                if e <= self.budget[child] and e < now.get(child, 99):
                    now[child] = e
                    todo.append(child)
        return tuple(sorted(now.items()))

    def _state(self, now: tuple) -> int:
        if now not in self.ids:
            self.ids[now] = len(self.sets)
            self.sets.append(now)
            self.next.append({})
            best = lambda ends: min((e for n, e in now if 0 <= e <= ends[n]), default=-1)
            word, stem = best(self.word_end), best(self.stem_end)
            stop = 0 if stem < 0 else EXACT if stem == 0 else FUZZY
            self.stops.append(stop)
            self.ends.append(EXACT if word == 0 or stop == EXACT else FUZZY if word > 0 or stop else 0)
        return self.ids[now]

    def _step(self, state: int, c: str) -> int:
        now: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < now.get(node, 99):
                now[node] = e

        for node, e in self.sets[state]:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        to = self._state(self._closed(now)) if now else -1
        self.next[state][c] = to
        return to

    def find(self, word: str) -> int:
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        state, fuzzy = 0, 0
        for c in word:
            to = self.next[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return fuzzy
            state = to
            if self.stops[state] == EXACT:
                return EXACT
            fuzzy = fuzzy or self.stops[state]
        return self.ends[state] or fuzzy


def is_quoted(text: str, start: int, end: int, before: list[str]) -> bool:
    left, right = text[max(0, start - NEAR) : start].rpartition("\n")[2], text[end : end + NEAR].partition("\n")[0]
    if left.count('"') % 2 and '"' in right:
        return True
    if any(left.rfind(a) > left.rfind(b) and b in right for a, b in PAIRS):
        return True
    return any(w in REPORTING for w in before)


class Counter3:
    """Counts of one text: (exact hits, misspelled hits, quoted hits, size class)."""

    #: Words whose answer is remembered.
    MEMORY = 300_000

    def __init__(self, terms: list[tuple[str, bool]]):
        self.lexicon, self.known = Lexicon(terms), {}

    def __call__(self, text: str | None) -> tuple[int, int, int, int]:
        low = (text or "").lower()
        words = WORD.findall(low)
        known, find, hits = self.known, self.lexicon.find, set()
        for w in set(words):
            kind = known.get(w)
            if kind is None:
                if len(known) >= self.MEMORY:
                    known.clear()
                kind = known[w] = find(w)
            if kind:
                hits.add(w)
        counts = [0, 0, 0]
        if hits:
            last: list[str] = []
            for m in WORD.finditer(low):
                w = m.group()
                if w in hits:
                    counts[2 if is_quoted(low, m.start(), m.end(), last) else known.get(w, EXACT) - 1] += 1
                last = [*last[1 - BEFORE :], w]
        n = len(words)
        return (min(counts[0], 6), min(counts[1], 6), min(counts[2], 6), sum(n >= x for x in (1, 20, 100, 500, 2000)))


def features(counts: tuple[int, int, int, int]) -> list[float]:
    a, f, q, size = counts
    return [1.0, a > 0, np.log1p(a), f > 0, np.log1p(f), q > 0, np.log1p(q), (a + f) / (size + 1.0)]


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)


def terms_of(words: list[str]) -> Iterator[tuple[str, str]]:
    """(term, word before) for the words and stems of a text; stems end in a star."""
    before = ""
    for w in words:
        if len(w) > 2:
            yield w, before
            for n in STEMS:
                if n < len(w):
                    yield w[:n] + "*", before
        before = w


def ratio(hits: int, misses: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio of a term's toxic share against the base rate."""
    share, n = n_toxic / (n_toxic + n_clean), hits + misses
    part = lambda k, p: k * np.log(k / n / p) if k else 0.0
    return 2 * (part(hits, share) + (part(misses, 1 - share) if n_clean else 0.0))


def choose(toxic: dict[str, tuple[int, int]], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """Terms from (contexts, documents) by term in toxic documents and documents by term in the others."""
    least = max(LEAST_CONTEXTS, CONTEXT_SHARE * n_toxic)
    good = {t: docs for t, (contexts, docs) in toxic.items() if contexts >= least
            and docs / n_toxic >= LIFT * (clean.get(t, 0) + 0.5) / (n_clean + 1)
            and ratio(docs, clean.get(t, 0), n_toxic, n_clean) >= LEAST_RATIO}
    dropped = set()
    for term, docs in good.items():  # a stem that one longer term accounts for gives way to that
        for n in STEMS:
            stem = term.rstrip("*")[:n] + "*"
            if stem != term and len(stem) <= len(term.rstrip("*")) + 1 and docs >= 0.8 * good.get(stem, docs + 1e9):
                dropped.add(stem)
    left = sorted(t for t in good if t not in dropped)
    stems = {t[:-1] for t in left if t[-1] == "*"}
    longer = lambda t: any(t.rstrip("*")[:n] in stems for n in STEMS if n < len(t.rstrip("*")) or (n == len(t) and t[-1] != "*"))
    return [(t.rstrip("*"), t[-1] == "*") for t in left if not longer(t)]


def needed(terms: list[tuple[str, bool]], rows: list[tuple[list[int], int, int]]) -> list[tuple[str, bool]]:
    """The terms that tell something on top of stronger ones, from (numbers of the terms in a text, label, texts).

    Greedy: the term with the largest ratio is taken, its texts are set aside, and the rest are judged on what is left.
    """
    has = np.zeros((len(rows), len(terms)), bool)
    for i, (found, _, _) in enumerate(rows):
        has[i, found] = True
    label, n = np.array([r[1] for r in rows]) == 1, np.array([r[2] for r in rows], float)
    left, taken = np.ones(len(rows), bool), []
    while True:
        toxic, clean = n * (left & label), n * (left & ~label)
        hits, misses = toxic @ has, clean @ has
        ratios = [ratio(h, m, toxic.sum(), clean.sum()) if h / max(toxic.sum(), 1) >= LIFT * (m + 0.5) / (clean.sum() + 1) else 0.0
                  for h, m in zip(hits, misses)]
        best = int(np.argmax(ratios)) if ratios else 0
        if not ratios or ratios[best] < LEAST_RATIO:
            return [terms[i] for i in sorted(taken)]
        taken.append(best)
        left &= ~has[:, best]


def regression(cells: list[tuple[tuple[int, int, int, int], int, int]]) -> list[float]:
    """Ridge logistic regression by Newton steps over (counts, label, documents)."""
    if not cells:
        return [-2.0] + [0.0] * (len(features((0, 0, 0, 0))) - 1)
    x = np.array([features(c) for c, _, _ in cells], float)
    y, n = np.array([label for _, label, _ in cells], float), np.array([k for _, _, k in cells], float)
    ridge = np.full(x.shape[1], 0.5)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """Lexicon and weights from at most ``sample`` labelled ids; the label of an id is the largest given for it.

    Only that sample's ids are broadcast and only its texts are written, once. A term must appear in a fixed share of the
    toxic texts of the sample, so the terms that reach the driver are bounded by the size of the texts alone, not the
    corpus. Without labels, or without toxic ones, the lexicon is empty and every text gets the base rate.
    """
    ids = (labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
           .where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    known = kept(rows.join(F.broadcast(ids), "id").select("text", F.col("label").cast("int").alias("label")), "labelled")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    terms: list[tuple[str, bool]] = []
    if n_toxic:
        def contexts(batches):
            for batch in batches:
                for text in batch["text"].to_pylist():
                    pairs = list(set(terms_of(WORD.findall((text or "").lower()))))
                    first: set[str] = set()
                    new = [t not in first and not first.add(t) for t, _ in pairs]
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array(
                        [b for _, b in pairs], pa.string()), pa.array([int(x) for x in new], pa.int32())], ["term", "before", "docs"])

        pairs = known.where("label = 1").select("text").mapInArrow(contexts, "term string, before string, docs int")
        found = pairs.groupBy("term", "before").agg(F.sum("docs").alias("docs")).groupBy("term").agg(
            F.count("*").alias("contexts"), F.sum("docs").alias("docs"))
        least = max(LEAST_CONTEXTS, CONTEXT_SHARE * n_toxic)
        toxic = {r["term"]: (r["contexts"], r["docs"]) for r in found.where(F.col("contexts") >= least).collect()}
        wanted = frozenset(toxic)

        def counts(batches):
            total: Counter[str] = Counter()
            for batch in batches:
                for text in batch["text"].to_pylist():
                    total.update({t for t, _ in terms_of(list(set(WORD.findall((text or "").lower()))))} & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                             ["term", "docs"])

        others = known.where("label <> 1").select("text").mapInArrow(counts, "term string, docs long")
        clean = {r["term"]: r["n"] for r in others.groupBy("term").agg(F.sum("docs").alias("n")).collect()}
        terms = choose(toxic, clean, n_toxic, n_clean)
        number = {t + "*" * stem: i for i, (t, stem) in enumerate(terms)}

        def present(batches):
            total: Counter[tuple] = Counter()
            for batch in batches:
                for text, y in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                    found = {t for t, _ in terms_of(list(set(WORD.findall((text or "").lower()))))} & number.keys()
                    total[tuple(sorted(number[t] for t in found)), y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([list(k[0]) for k in total], pa.list_(pa.int32())), pa.array(
                [k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["found", "label", "n"])

        seen = known.mapInArrow(present, "found array<int>, label int, n long").groupBy("found", "label").agg(F.sum("n").alias("n"))
        terms = needed(terms, [(r["found"], r["label"], r["n"]) for r in seen.collect()])

    def cells(batches):
        count, total = Counter3(terms), Counter()
        for batch in batches:
            total.update(zip(map(count, batch["text"].to_pylist()), batch["label"].to_pylist()))
        rows = [(*c, y, n) for (c, y), n in total.items()]
        names = ["a", "f", "q", "size", "label", "n"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)

    table = known.mapInArrow(cells, "a long, f long, q long, size long, label long, n long")
    rows = table.groupBy("a", "f", "q", "size", "label").agg(F.sum("n").alias("n")).orderBy("a", "f", "q", "size", "label").collect()
    return Model(terms, regression([((r["a"], r["f"], r["q"], r["size"]), int(r["label"] == 1), r["n"]) for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score, abuse_hits, misspelled_hits, quoted_hits): every row as a struct; hits count to 6 at most.

    Row by row over whole texts, without a shuffle. Empty and null texts have no hits and get the score of those.
    """
    rows = packed(docs, text=F.col(f"`{text}`"))
    schema = schema_with(rows.select("row"), ("score", T.DoubleType()), *((n, T.IntegerType()) for n in (
        "abuse_hits", "misspelled_hits", "quoted_hits")))
    terms, weights = model.terms, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, scores = Counter3(terms), {}
        for batch in batches:
            found = [count(t) for t in batch["text"].to_pylist()]
            for c in set(found) - scores.keys():
                scores[c] = float(1 / (1 + np.exp(-np.clip(np.dot(weights, features(c)), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([scores[c] for c in found], pa.float64()), *(
                pa.array([c[i] for c in found], pa.int32()) for i in range(3))], schema.fieldNames())

    return rows.mapInArrow(run, schema)
