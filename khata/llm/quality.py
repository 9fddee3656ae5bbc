"""Quality rules: how well a text compresses, as a whole and in fixed chunks, within limits that depend on its length."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.llm import hashing as H


class Band(NamedTuple):
    """Limits of compressed size by size, for texts of at least ``least`` bytes."""

    least: int
    low: float
    high: float


#: Short texts have little to repeat and carry the frame's own bytes, so their band lies higher.
BANDS = [Band(0, 0.0, 9.9), Band(200, 0.12, 0.95), Band(1000, 0.10, 0.85), Band(5000, 0.08, 0.75), Band(50000, 0.06, 0.70)]
#: Chunks of this many bytes are compressed on their own, in texts that have one; a last one that is shorter than half of that
#: has the band of a text of its length.
CHUNK = 4096
CHUNK_BAND = Band(CHUNK // 2, 0.08, 0.85)
#: The text fails if more than this share of its chunks lie outside the band.
BAD_CHUNKS = 0.5
LEVEL = 3
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = """key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long"""


def word_figures(texts: H.Texts) -> list[np.ndarray]:
    """Per row: words, code points in words, symbols, repeated lines, words in repeated windows."""
    data, offsets, rows = texts.data, texts.offsets, len(texts.offsets) - 1
    words = H.split_words(texts)
    n_words = np.diff(words.first)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    chars = total(~H.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = total(SYMBOLS[data])

    # lines with a word, cut at \n and at the texts' edges
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    starts, ends = cuts[:-1], cuts[1:]
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10) if len(data) else 0)
    wordy = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends = starts[wordy], ends[wordy]
    row = np.searchsorted(offsets, starts, "right") - 1
    lines = H.span_hashes(data, starts, ends) ^ H.mix(row.astype(np.uint64))
    dup_lines = np.bincount(row, minlength=rows) - np.bincount(row[np.unique(lines, return_index=True)[1]], minlength=rows)

    runs = H.run_hashes(H.span_hashes(data, words.starts, words.ends), WINDOW)
    whole = np.flatnonzero(H.whole_runs(words, WINDOW))
    own = runs[whole] ^ H.mix(words.row[whole].astype(np.uint64) + np.uint64(1))  # equal runs of one row only
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = H.covered(whole[twice], WINDOW, len(words.row))
    repeated = np.bincount(words.row[inside], minlength=rows)
    return [n_words, chars, symbols, dup_lines, repeated]


def band_of(size: int) -> Band:
    return next(b for b in reversed(BANDS) if size >= b.least)


def judged(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[bool, float, int, int, int]:
    """Verdict of the bands, ratio of the whole, chunks, chunks below and above their band."""
    if not raw:
        return False, 0.0, 0, 0, 0
    ratio = len(press.compress(raw)) / len(raw)
    band = band_of(len(raw))
    low = high = chunks = 0
    if len(raw) >= CHUNK:
        for at in range(0, len(raw), CHUNK):
            piece = raw[at : at + CHUNK]
            own = CHUNK_BAND if len(piece) >= CHUNK_BAND.least else band_of(len(piece))
            chunks += 1
            r = len(press.compress(piece)) / len(piece)
            low += r < own.low
            high += r > own.high
    ok = band.low <= ratio <= band.high and low + high <= BAD_CHUNKS * chunks
    return ok, ratio, chunks, low, high


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of figures and verdicts for each document, without a shuffle; see ``SCHEMA``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in five-word windows that the text has twice.
    ``kept``: not that, and the compressed sizes lie in their bands. A null text is an empty one and fails. Texts are
    handled whole, a long one by itself. Repeated rows get the same figures; other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = SCHEMA.format(kind=rows.schema["key"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for texts in H.slices(batch["text"]):
                figures = word_figures(texts)
                n, repeats = figures[0], figures[4]
                failed = (n < 10) | (100 * repeats > 20 * n)
                raw, at = texts.data.tobytes(), texts.offsets
                bands = [judged(raw[a:b], press) for a, b in zip(at[:-1], at[1:])]
                ok, ratio, chunks, low, high = (np.array(x) for x in zip(*bands))
                yield pa.RecordBatch.from_arrays([
                    batch["key"].slice(texts.first, len(n)), *(pa.array(f, pa.int64()) for f in figures),
                    pa.array(failed), pa.array(~failed & ok), pa.array(np.diff(at), pa.int64()), pa.array(ratio, pa.float64()),
                    *(pa.array(x, pa.int64()) for x in (chunks, low, high))],
                    names=["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           "kept", "n_bytes", "ratio", "n_chunks", "n_low_chunks", "n_high_chunks"])

    return rows.mapInArrow(run, schema)
