"""Long texts and URLs: bounded memory, and the same results as in one piece."""

import random
import resource

import numpy as np
import pytest

from khata.llm import decontaminate, hashing, url_filter


def grown(work):
    """Megabytes by which the process grew at most, and what the work gave."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = work()
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, out


@pytest.mark.parametrize("size", [16, 64, 1000])
def test_hashes_by_slices(monkeypatch, size):
    r = random.Random(size)
    text = " ".join("x" * r.choice([1, 3, 9, 70, 300]) + str(r.randrange(50)) for _ in range(400)).encode()
    column = hashing.pa.array([text.decode()])
    words = hashing.split_words(next(hashing.slices(column)))
    data = np.frombuffer(text, np.uint8)
    whole = hashing.span_hashes(data, words.starts, words.ends)
    monkeypatch.setattr(hashing, "SLICE_BYTES", size)
    monkeypatch.setattr(hashing, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    assert (hashing.span_hashes(data, words.starts, words.ends) == whole).all()
    assert len(hashing._powers[0]) <= size + 1
    assert len(set(whole.tolist())) == len({text[a:b] for a, b in zip(words.starts, words.ends)})


def test_long_text_of_words():
    text = np.frombuffer(("word " * 10_000_000).encode(), np.uint8)
    starts = np.arange(0, len(text), 5)
    mb, hashes = grown(lambda: hashing.span_hashes(text, starts, starts + 4))
    assert mb < 500 and (hashes == hashes[0]).all()


def test_long_url():
    automaton = url_filter.Automaton([".example.com/a**z", ".short/*", "**needle**"])
    texts = [f".short/{i}" for i in range(2047)] + [".example.com/a" + "b" * 1_000_000 + "z", ".x/" + "y" * 700 + "needle" + "y" * 300]
    mb, fits = grown(lambda: automaton.fits(texts))
    assert mb < 500 and fits[:2047, 1].all() and fits[2047].tolist() == [True, False, False] and fits[2048].tolist() == [False, False, True]


def test_one_character_throughout():
    items = decontaminate.Items([(1, b"_" * 100), (2, b"a plain item of some words")])
    mb, found = grown(lambda: list(items.search([b"_" * 2_000_000 + b" a plain item of some words", b"nothing"])))
    assert mb < 500 and sorted((f.row, f.item, f.edits) for f in found) == [(0, 1, 0), (0, 2, 0)]


def test_places_are_counted_alike(monkeypatch):
    r = random.Random(3)
    items = [(i, "".join(r.choice("ab ") for _ in range(r.randint(8, 60))).encode()) for i in range(30)]
    texts = [b"".join(r.choice(items)[1][r.randint(0, 3):] for _ in range(5)) for _ in range(40)]
    whole = sorted(decontaminate.Items(items).search(texts))
    for places, cells in ((1, 1), (50, 300), (1000, 5000)):
        monkeypatch.setattr(decontaminate, "PLACES", places)
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        assert sorted(decontaminate.Items(items).search(texts)) == whole


def test_short_items():
    items = decontaminate.Items([(1, b"yes"), (2, b"a b"), (3, b""), (4, b"yes"), (5, b"b c")])
    found = sorted((f.row, f.item, f.start, f.end) for f in items.search([b"yesterday", b"oh yes: a b c", b"", "é yesé".encode()]))
    assert found == [(1, 1, 3, 6), (1, 2, 8, 11), (1, 4, 3, 6), (1, 5, 10, 13)]
