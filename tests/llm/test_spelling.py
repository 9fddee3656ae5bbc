"""Spelling variants against all pairs, in lists of any size."""

import random
import re
import zlib

import pytest

from khata.llm import queries, spelling

SF = "/root/testdata/sf0.001"
LETTERS = re.compile(r"[A-Za-z\u00C0-\u00FF]+")


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    u, v = sorted((u, v), key=len)
    at = next((i for i in range(len(u)) if u[i] != v[i]), len(u))
    return u[at + 1 :] == v[at + 1 :] if len(u) == len(v) else u[at:] == v[at + 1 :]


def plain_words(rows):
    counts = {}
    for doc, text in rows:
        for run in LETTERS.findall(text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] = counts.get(low, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


@pytest.mark.parametrize("alphabet", ["ab", "abé"])
def test_scan_matches_all_pairs(alphabet):
    r = random.Random(5)
    for _ in range(150):
        words = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(40)})
        got = sorted(spelling.scan(words, range(len(words))))
        assert got == sorted((i, j) for i, u in enumerate(words) for j, v in enumerate(words) if one_edit(u, v))


@pytest.mark.parametrize("longest", [1, 5, 128])
def test_variants_match_all_pairs(spark, longest):
    """A hot prefix, a hot suffix, repeated letters, words of several lengths; lists cut down to single places."""
    r = random.Random(longest)
    words = {"".join(r.choice("ab") for _ in range(r.randint(7, 9))) for _ in range(150)}
    words |= {"prefixes" + "".join(r.choice("abc") for _ in range(r.randint(0, 4))) for _ in range(60)}
    words |= {"".join(r.choice("xyé") for _ in range(r.randint(1, 4))) + "endings" for _ in range(60)} | {"a" * n for n in range(7, 40)}
    counts = {w: r.choice([2, 3, 30, 31, 400]) for w in words}
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), longest).collect()
    assert len(rows) == len(counts)
    for x in rows:
        near = [v for v in counts if one_edit(x["word"], v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        assert (x["near"], x["best"], x["best_n"]) == (len(near), best, counts.get(best))


def test_groups_of_documents(spark):
    """Chains of forms, ties, capitals beyond A to Z, null ids and texts, repeated rows, and dropped code points."""
    r = random.Random(2)
    base = ["documents", "Documents", "dokuments", "documentos", "ÉCOLIÈRES", "Écolières", "straßenbahn", "strasenbahn", "abcdefg", "abcdefgh", "short"]
    data = [(r.choice([None, i, i // 3]), r.choice([None, "", " ".join(r.choice(base[: 1 + r.randrange(len(base))]) for _ in range(r.randint(0, 60)))]))
            for i in range(300)]
    counts = plain_words(data)
    got = {tuple(x) for x in spelling.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_groups(counts)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    counts = plain_words([tuple(x) for x in docs])
    rows = queries.op11_spelling_variants(spark, SF).collect()
    assert {x["word"]: x["n"] for x in rows} == counts


def test_edges(spark, edge, nothing):
    found = {x["word"]: (x["form"], x["n"]) for x in spelling.groups(edge).collect()}
    assert found == {}  # no word of seven letters twice
    assert spelling.groups(nothing).count() == 0
