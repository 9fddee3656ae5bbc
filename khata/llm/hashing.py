"""Words of Arrow string columns as numpy arrays: places, and 64-bit fingerprints of words, word runs and spans.

A fingerprint is a polynomial over random values of the bytes, taken from running sums modulo 2**64, and then mixed.
It is the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at a time. One text that is longer is handled alone.
SLICE_BYTES = 1 << 20
#: Words are runs of bytes other than these.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for no more than ``SLICE_BYTES`` bytes."""
    if len(_powers[0]) < n:
        n = SLICE_BYTES + 1
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each span of bytes; spans stand in order and do not overlap.

    Sums run over at most ``SLICE_BYTES`` at a time: spans that fit together are hashed together, a longer one piece by piece.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + SLICE_BYTES, "right"))
        if to > at:
            out[at:to] = _sums(data[base : int(ends[to - 1])], starts[at:to] - base, ends[at:to] - base)
        else:
            to, sofar, factor = at + 1, np.zeros(1, np.uint64), 1
            for piece in range(base, int(ends[at]), SLICE_BYTES):
                part = data[piece : min(piece + SLICE_BYTES, int(ends[at]))]
                sofar += _sums(part, np.zeros(1, np.int64), np.full(1, len(part))) * np.uint64(factor)
                factor = factor * pow(_BASE, len(part), 1 << 64) % (1 << 64)
            out[at] = sofar[0]
        at = to
    return mix(out + (ends - starts).astype(np.uint64))


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values of each span's bytes, each times the base to the power of its place in the span."""
    power, inverse = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each run of k neighbouring words; entry i is the run that starts at i."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


class Texts(NamedTuple):
    """Some neighbouring rows of a batch: ``data[offsets[i]:offsets[i + 1]]`` are the bytes of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows in groups of at most ``limit`` bytes, or of one row."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Words(NamedTuple):
    """Words of a group of rows. ``first[i]:first[i + 1]`` are the words of row i, ``row`` is the row of each word."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def split_words(texts: Texts) -> Words:
    data, offsets = texts.data, texts.offsets
    inside = ~SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    return Words(starts, np.flatnonzero(end) + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def whole_runs(words: Words, k: int) -> np.ndarray:
    """Whether the run of k words from each place (of those that ``run_hashes`` gives) lies in one row."""
    n = max(0, len(words.row) - k + 1)
    return words.row[:n] == words.row[k - 1 : k - 1 + n]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places a run of k from one of the starts covers."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + k, n), -1)
    return np.cumsum(steps[:n]) > 0
