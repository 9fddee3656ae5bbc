"""Glob rules over URLs by a bit-parallel wildcard automaton.

All patterns are packed into one row of 64-bit words, a bit per state: bit i of a pattern says that its first i characters
have been met. One step per character moves every pattern at once, ``D = (D << 1) & B[c] | D & stay[c]``, where ``B`` has
the bits that a character reaches and ``stay`` those that a star holds. A shift carries from word to word. The URLs of a
batch step together, as rows of a numpy array.

In a pattern ``*`` stands for any characters but ``/``, ``**`` for any at all, ``?`` for one character but ``/``. Patterns
are matched against the whole canonical URL: a dot, the lower-case host, and the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GlobRule(NamedTuple):
    name: str
    verdict: str
    glob: str


def site_rule(verdict: str, rule: str) -> GlobRule:
    """Rule ``host/path``: that host and all its subdomains, if the path starts with the rule's."""
    host, _, path = rule.partition("/")
    return GlobRule(rule, verdict, f"*.{host}/{path}**")


#: The longest name wins among these.
SITE_RULES = [site_rule("block", "net/"), site_rule("allow", "example.net/en/"),
              site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/")]
#: For URLs that no site rule fits: blocked where one of these fits, and else allowed.
WORD_RULES = [GlobRule(g, "block", g) for g in (
    "*spam*", "*spam*/**", "*adult*", "*adult*/**", "*casino*", "*casino*/**", "*.xxx", "*.xxx/**",
    "**/login/**", "**/wp-admin/**", "**/ads/**", "**.exe", "**.zip")]

#: Characters of a text that are turned to codes at a time.
STRIP = 256


class Automaton:
    """Masks of a list of globs."""

    def __init__(self, globs: list[str]):
        tokens = [re.findall(r"\*\*+|\*|\?|.", g, re.S) for g in globs]
        letters = sorted({t for ts in tokens for t in ts if len(t) == 1 and t not in "*?"} | {"/"})
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        bits = sum(1 + sum(t[0] != "*" for t in ts) for ts in tokens)
        self.words = max(1, -(-bits // 64))
        k = len(letters) + 1
        self.reach, self.stay = np.zeros((k, self.words), np.uint64), np.zeros((k, self.words), np.uint64)
        self.start, self.finals = np.zeros(self.words, np.uint64), []
        every, slash = range(k), self.code["/"]

        def put(mask: np.ndarray, bit: int) -> None:
            mask[bit // 64] |= np.uint64(1 << (bit % 64))

        bit = 0
        for ts in tokens:
            put(self.start, bit)
            for t in ts:
                if t[0] == "*":
                    for c in every:
                        if len(t) > 1 or c != slash:
                            put(self.stay[c], bit)
                else:
                    bit += 1
                    for c in [c for c in every if c != slash] if t == "?" else [self.code[t]]:
                        put(self.reach[c], bit)
            self.finals.append((bit // 64, np.uint64(1 << (bit % 64))))
            bit += 1

    def fits(self, texts: list[str]) -> np.ndarray:
        """A row per text and a column per glob: whether it fits the whole text. Texts of like length step together."""
        out = np.zeros((len(texts), len(self.finals)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for lo in range(0, len(order), 2048):
            part = order[lo : lo + 2048]
            sizes = np.array([len(texts[i]) for i in part])
            now = np.tile(self.start, (len(part), 1))
            for strip in range(0, int(sizes.max(initial=0)), STRIP):  # no array is as wide as the longest text
                begun = int(np.searchsorted(sizes, strip, "right"))  # shorter texts have ended
                codes = np.zeros((STRIP, len(part) - begun), np.uint16)
                for k, i in enumerate(part[begun:]):
                    piece = texts[i][strip : strip + STRIP]
                    codes[: len(piece), k] = [self.code.get(c, 0) for c in piece]
                for at in range(min(STRIP, int(sizes[-1]) - strip)):
                    first = int(np.searchsorted(sizes, strip + at, "right"))
                    d = now[first:]
                    moved = d << np.uint64(1)
                    moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                    c = codes[at, first - begun :]
                    now[first:] = (moved & self.reach[c]) | (d & self.stay[c])
            out[part] = np.stack([(now[:, w] & m) != 0 for w, m in self.finals], axis=1)
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` or null: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, key: str, url: str, site_rules: list[GlobRule] = SITE_RULES,
          word_rules: list[GlobRule] = WORD_RULES) -> DataFrame:
    """(key, host, path, rule, verdict, word_rule) for each row, without a shuffle.

    ``rule`` is the longest site rule that fits, and its verdict holds. Else ``word_rule`` is the first word rule that
    fits; without one the URL is allowed. A null URL and one without ``://`` have no host or path and are allowed.
    Repeated rows are judged alike; other columns are not read.
    """
    rules = sorted(site_rules, key=lambda r: (-len(r.name), r.name)) + list(word_rules)
    globs, own = [r.glob for r in rules], len(site_rules)
    rows = pages.select(F.col(f"`{key}`").alias("key"), host_of(F.col(f"`{url}`")).alias("host"),
                        path_of(F.col(f"`{url}`")).alias("path"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.StringType()) for n in ("rule", "verdict", "word_rule"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            fits = automaton.fits([f".{h}{p}" for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())])
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist()
            found = [rules[i] if i >= 0 else None for i in first]
            columns = [[r.name if r and i < own else None for r, i in zip(found, first)],
                       [r.verdict if r else "allow" for r in found],
                       [r.name if r and i >= own else None for r, i in zip(found, first)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)],
                                             names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
