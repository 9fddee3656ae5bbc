"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton accepts exactly the token sequences that the merges produce. It starts as one state with an arc for every
base symbol. Merge (u, v) puts in a gadget: let q be the state that u leads to. Arcs of u now lead to a copy of q without
its v arc, so v can no longer follow u, and every state with a u arc gets an arc for the joined token, which leads where
v led from q. Every token leads to one state from wherever it is read, so a merge adds one state at most.

Copies share what they have in common: a state keeps its parent, the merge that made it and the arc it lost, and whether
it has an arc for a token follows from those; how merges met at the border of two tokens tells the same in a few steps.
Answers are kept in a table, filled as pairs are first met.

The labels of the tokens are compiled into one transition table over bytes. Encoding goes over a word from left to right.
Every prefix has one tokenization, so only one state of the automaton can be live at a place: from there the table is followed
byte by byte, and of the labels that end on the way the longest is taken for which that state has an arc.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.llm.frames import packed, release, schema_with, sized

#: Pieces that are remembered, twice over, and the longest of them.
MEMORY, LONGEST = 100_000, 64
#: Arcs that are remembered.
ARCS = 200_000
ROOT = 0
#: Bytes of text, or rows, that are encoded before they are handed on.
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file of this kind holds: normalization NFC and lower case, words by a pattern, byte letters."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    pattern: str
    word_end: str
    special: dict[str, int]
    digest: str


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file; only the kind whose steps are built here is taken."""
    with open(path, "rb") as file:
        raw = file.read()
    j = json.loads(raw)
    kinds = [s["type"] for s in j["normalizer"]["normalizers"]], [s["type"] for s in j["pre_tokenizer"]["pretokenizers"]]
    if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or j["decoder"] is not None:
        raise ValueError(f"a tokenizer of another kind: {kinds}")
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in j["model"]["merges"]]
    return Vocabulary(j["model"]["vocab"], merges, j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
                      j["model"]["end_of_word_suffix"] or "", {a["content"]: a["id"] for a in j["added_tokens"]},
                      hashlib.sha256(raw).hexdigest())


def byte_letters() -> dict[int, str]:
    """A printable letter for every byte: itself where it is one, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Automaton:
    """States and arcs; token numbers are those of the vocabulary."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        size = max(ids.values(), default=0) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size  # halves and merge of a token; -1: a base symbol
        self.state = [ROOT] * size  # where a token leads
        self.parent, self.made, self.lost = [-1], [-1], [-1]
        self.rank: dict[int, int] = {}  # merges by their pair
        self.arcs: dict[int, bool] = {}
        self.size = size
        for rank, (a, b) in enumerate(merges):
            u, v, joined = ids[a], ids[b], ids[a + b]
            if not self.follows(u, v):
                self.born[joined] = len(merges)  # no word holds this pair when its turn comes
                continue
            self.left[joined], self.right[joined], self.born[joined], self.state[joined] = u, v, rank, self.state[v]
            self.rank[u * size + v] = rank
            self.parent.append(self.state[u])
            self.made.append(rank)
            self.lost.append(v)
            self.state[u] = len(self.parent) - 1

    def has_arc(self, state: int, token: int) -> bool:
        """Whether a state has an arc for a token, by its making: back over copies, and over first halves of later tokens."""
        while state != ROOT:
            if self.lost[state] == token:
                return False
            if self.born[token] >= self.made[state]:
                token = self.left[token]
                if token < 0:
                    return False
            else:
                state = self.parent[state]
        return True

    def follows(self, before: int, token: int) -> bool:
        """The same for the state that ``before`` leads to, in as many steps as the two tokens have halves at their border.

        The arc was lost if, before the halves that meet there were joined to what they are, a merge of theirs had its turn.
        Where the second token's last merge and that one are the same, the one further left came first.
        """
        left, right, born, rank, size = self.left, self.right, self.born, self.rank.get, self.size
        turn = len(rank.__self__) + len(born)
        while True:
            found = rank(before * size + token)
            if found is not None and found < turn:
                return False
            if born[before] > born[token]:
                turn, before = born[before], right[before]
            elif born[token] >= 0:
                turn, token = born[token] + 1, left[token]
            else:
                return True

    def arc(self, before: int, token: int) -> bool:
        """:meth:`follows`, remembered."""
        if len(self.arcs) >= ARCS:
            self.arcs.clear()
        found = self.arcs[before * self.size + token] = before < 0 or self.follows(before, token)
        return found


class Tokenizer:
    """Encodes and decodes texts as one vocabulary asks."""

    def __init__(self, v: Vocabulary):
        self.v, self.automaton = v, Automaton(v.ids, v.merges)
        self.letters = {b: c for b, c in byte_letters().items()}
        self.split = regex.compile(v.pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        dead = {t for t, n in enumerate(self.automaton.born) if n == len(v.merges)}
        self.ids = {s: i for s, i in v.ids.items() if i not in dead}
        self._compile()
        self.label = {i: s for s, i in [*v.ids.items(), *v.special.items()]}
        self.number = {i: str(i) for i in self.label}
        self.new: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def _compile(self) -> None:
        """The labels of all tokens as one transition table: each state has the next ones by byte, and the tokens that it
        completes within a word and at its end."""
        byte = {c: b for b, c in self.letters.items()}
        end = self.v.word_end
        self.table = [{}, -1, -1]
        for label, token in self.ids.items():
            last = bool(end) and label.endswith(end)
            body = label[: len(label) - len(end)] if last else label
            if not body or any(c not in byte for c in body):
                continue
            at = self.table
            for c in body:
                at = at[0].setdefault(byte[c], [{}, -1, -1])
            at[2 if last else 1] = token
            if not end:
                at[2] = token

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word of the pattern.

        From a place the table is followed as far as labels go, and the longest label that the automaton's state has an arc
        for is taken. Where nothing leads to the end of the word, a shorter one is; a place that was left is never tried
        again, as one state only can be live there.
        """
        data, table = word.encode(), self.table
        arcs, known, size = self.automaton.arc, self.automaton.arcs.get, self.automaton.size
        n, start, q, left = len(data), 0, -1, set()  # q: the token that leads to the live state
        out, path = [], []
        while start < n:
            at, end, able = table, start, []
            for symbol in data[start:] if start else data:
                at = at[0].get(symbol)
                if at is None:
                    break
                end += 1
                if at[1] >= 0 and end < n:
                    able.append((end, at[1]))
            else:
                if at[2] >= 0:
                    able.append((end, at[2]))
            while True:
                while able:
                    end, token = able.pop()
                    if end not in left:
                        ok = known(q * size + token)
                        if ok or ok is None and arcs(q, token):
                            break
                else:  # nothing from here
                    if not path:
                        return []
                    left.add(start)
                    start, q, able = path.pop()
                    out.pop()
                    continue
                break
            path.append((start, q, able))
            out.append(token)
            start, q = end, token
        return out

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined as this kind of file asks when it names no decoder."""
        return " ".join(map(self.label.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[int, str, str]:
        """(tokens, their ids, their labels) of a piece without blanks; what is asked again is kept in two generations."""
        found = self.old.get(piece)
        if found is None:
            words = self.split(piece)
            if len(words) == 1:
                found = self._word(words[0])
            else:
                parts = [self.new.get(w) or self._piece(w) for w in words]
                found = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        if len(piece) <= LONGEST:
            if len(self.new) >= MEMORY:
                self.old, self.new = self.new, {}
            self.new[piece] = found
        return found

    def _word(self, word: str) -> tuple[int, str, str]:
        ids, number, label = self.encode_word(word), self.number, self.label
        if len(ids) == 1:
            return 1, number[ids[0]], label[ids[0]]
        return len(ids), " ".join([number[i] for i in ids]), " ".join([label[i] for i in ids])

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, ids joined by spaces, decoded text)."""
        n, ids, labels, known = 0, [], [], self.new.get
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.v.special:
                n += 1
                ids.append(str(self.v.special[part]))
                labels.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no form of its own at the end of a word
            for piece in part.lower().replace("\n", " ").split(" "):
                found = known(piece)
                if found is None:
                    if not piece:
                        continue
                    found = self._piece(piece)
                    known = self.new.get  # may have been turned over
                if found[0]:
                    n += found[0]
                    ids.append(found[1])
                    labels.append(found[2])
        return n, " ".join(ids), " ".join(labels)

    def forget(self) -> None:
        """Give back what was remembered: workers go on to other work."""
        self.new, self.old = {}, {}
        self.automaton.arcs.clear()


_BUILT: dict[str, Tokenizer] = {}


def tokenizer(v: Vocabulary) -> Tokenizer:
    """One per process, however many tasks it runs."""
    if v.digest not in _BUILT:
        _BUILT.clear()
        _BUILT[v.digest] = Tokenizer(v)
    return _BUILT[v.digest]


OUTPUTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(),
           "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """(row, *outputs): every row as a struct, with its tokens; see ``OUTPUTS`` (digests are of ids joined by a space).

    Row by row over whole texts, without a shuffle. The vocabulary, of fixed size, is read on the driver and broadcast.
    Strings of special tokens in a text are those tokens. An empty text and a null one have no tokens and decode to "".
    """
    rows = packed(docs, text=F.col(f"`{text}`"))
    schema = schema_with(rows.select("row"), *((o, OUTPUTS[o]) for o in outputs))
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    make = {"n_tokens": lambda n, ids, text: n, "ids": lambda n, ids, text: [int(i) for i in ids.split()],
            "decoded": lambda n, ids, text: text, "ids_sha256": lambda n, ids, text: sha(ids),
            "decoded_sha256": lambda n, ids, text: sha(text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shared.value)
        gc.disable()  # nothing here has cycles, and what is remembered is costly to go over
        try:
            yield from encoded(own, batches)
        finally:
            gc.enable()
            own.forget()
            release()

    def encoded(own: Tokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in sized(whole["text"], BATCH_BYTES, 500):
                batch = whole.slice(at, n)
                found = [[make[o](*e) for o in outputs] for e in (own.encode(t.as_py() or "") for t in batch["text"])]
                columns = [pa.array([f[i] for f in found], types.get(o, pa.string())) for i, o in enumerate(outputs)]
                yield pa.RecordBatch.from_arrays([batch["row"], *columns], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(row, decoded): the text of an array of token ids in each row; null ids give null, none give ""."""
    rows = packed(df, ids=F.col(f"`{ids}`").cast("array<int>"))
    schema = schema_with(rows.select("row"), ("decoded", T.StringType()))
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], schema.fieldNames())

    return rows.mapInArrow(run, schema)
