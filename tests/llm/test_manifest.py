"""The Merkle manifest against plain trees in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from khata.llm import manifest, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def row_leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    sides = []
    for level in levels[:-1]:
        a = i // 8 * 8
        sides.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return sides


def plain(rows):
    groups = {}
    for doc, source, lang, n, text in rows:
        other = None
        if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
            lowered = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            other = row_leaf(doc, source, lang, n, lowered)
        groups.setdefault(lang, []).append(((doc is not None, doc or 0), row_leaf(doc, source, lang, n, text), other, doc))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: x[:2])
    trees = {g: tree([x[1] for x in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for place, g in enumerate(names):
        for i, (_, leaf, other, doc) in enumerate(groups[g]):
            sides = path(trees[g], i) + path(top, place)
            folded = other or leaf
            for left, right in sides:
                folded = digest(left + folded + right)
            out.append((doc, leaf, trees[g][-1][0], root, digest("".join(a + b for a, b in sides)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, langs", [(1, ["a"]), (9, ["a"]), (700, ["a", None, ""]), (4700, ["en"] * 9 + [None, "b"]),
                                      (600, [f"l{i}" for i in range(580)])])
def test_manifest(spark, rows, n, langs):
    """Nulls, repeated rows and ids, groups of one and of several blocks, more groups than a block has nodes."""
    r = random.Random(n)
    data = [(r.choice([None, i, i, i, i // 2]), r.choice([None, "s", "é"]), r.choice(langs), r.choice([None, 5]),
             r.choice([None, "", "Abc", "xyz", "ÉA b"])) for i in range(n)]
    assert rows(queries.manifest_rows(spark.createDataFrame(data, SCHEMA))) == plain(data)


def test_edges(spark, rows, edge, nothing):
    """Clashing names, a long text, repeated rows, and an empty table."""
    found = manifest.manifest(edge, "doc_id", "text", ["doc_id", "text"], {"group": F.col("key"), "place": F.col("row")})
    assert sorted(r["leaf"] for r in found.collect()) == sorted(row_leaf(r["doc_id"], r["text"]) for r in edge.collect())
    assert found.where(manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == edge.count()
    assert found.select("root").distinct().count() == 1
    assert manifest.manifest(nothing, "doc_id", "text", ["doc_id"], {"x": F.col("row")}).count() == 0


def test_equal_rows(spark):
    """A third of all rows equal: every one of them verifies."""
    data = [(7, "s", "en", 1, "x") if i % 3 == 0 else (i, "s", "en", 1, "y") for i in range(1500)]
    found = manifest.manifest(spark.createDataFrame(data, SCHEMA).repartition(7), "doc_id", "lang", ["doc_id", "text"], {"x": F.col("doc_id")})
    assert found.where(manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 1500
    assert found.select("path").distinct().count() == 1500
