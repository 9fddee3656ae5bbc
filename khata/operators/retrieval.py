"""Text chunks, nearest vectors and what they are worth as answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions import fixed_values as fv
from khata.session import written


# --- chunks --------------------------------------------------------------------------

def chunk_spans(text: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping chunks, cut behind the last sentence end inside each window.

    A cut so early that the next chunk would not start later makes it start at
    the cut instead.
    """
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cuts = ((text.rfind(mark, start, end), len(mark)) for mark in (". ", ".\n", "\n\n"))
            end = next((at + width for at, width in cuts if at > start), end)
        yield start, end
        start = end - overlap if end - overlap > start else end


def chunk_documents(df: DataFrame, key: str, text: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """One row per non-empty chunk: key, chunk_index, chunk and its MD5 id. Documents run in parallel, none is cut short."""
    schema = df.select(key).schema.add("chunk_index", T.LongType()).add("chunk", T.StringType())

    def chunks(batches):
        for pdf in batches:
            rows = []
            for k, body in zip(pdf[key], pdf[text]):
                parts = (body[a:b].strip() for a, b in chunk_spans(body or "", size, overlap))
                rows += [(k, i, part) for i, part in enumerate(p for p in parts if p)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    out = df.select(key, text).mapInPandas(chunks, schema)
    return out.withColumn("chunk_id", F.md5("chunk"))


def assemble_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Pages of a document as one text, each under its ``[Page n]`` line; pages without text are left out."""
    kept = pages.where(F.col(text).isNotNull() & (F.col(text) != ""))
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: F.concat(
        F.lit("\n[Page "), (x["p"] + 1).cast("string"), F.lit("]\n"), x["t"])), "").alias("full_text"))


def first_copies(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per distinct text, the one with the smallest key; copies are merged before they are shuffled."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(F.md5(text).alias("id")).agg(F.min(F.struct(key, *[c for c in rest if c == text])).alias("_f"))
            .select("id", f"_f.{key}", f"_f.{text}"))


def add_documents(store: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Store plus the fresh rows whose id it does not hold yet, one row per id."""
    return store.unionByName(fresh.dropDuplicates([key]).join(store.select(key), key, "left_anti"), allowMissingColumns=True)


# --- nearest vectors -----------------------------------------------------------------

def nearest(chunks: DataFrame, queries: DataFrame, n: int = fv.NEAREST_DEFAULT, where: Column | None = None,
            chunk_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """The ``n`` nearest chunks by cosine distance per query: query_id, place, chunk id, distance. Exact, for any number of queries.

    ``where`` filters the chunks first; rows without a vector are nobody's neighbours. Vectors of length one are dealt into
    cells around some of them, the pivots. A cell of radius r around p holds nothing nearer to a query q than |q - p| - r, and
    all of it is within |q - p| + r, so cells beyond those that surely hold n neighbours are skipped. What is left meets in
    blocks: some chunks of a cell and some of its queries in one task, which keeps the best ``n`` of each query; only those are
    ranked.
    """
    pool = (chunks if where is None else chunks.where(where)).where(F.col(vector).isNotNull()).select(chunk_id, vector)
    asked = written(queries.where(F.col(vector).isNotNull()).select(query_id, vector), "queries")
    sample = pool.orderBy(F.xxhash64(chunk_id, vector)).limit(PIVOTS).select(vector).collect()
    if not sample:
        return asked.where("false").select(query_id, F.lit(1).alias("place"), F.lit(None).cast(pool.schema[chunk_id].dataType).alias(chunk_id),
                                           F.lit(1.0).alias("distance"))
    pivots = _unit(np.array([r[0] for r in sample], dtype=np.float64))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, reach = _cells(_matrix(batch[vector]), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(reach)], [*batch.schema.names, "cell", "reach"])

    cells = pool.mapInArrow(dealt, _with(pool, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())))
    found = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()}
    around = Around(pivots, [(c, found[c]["n"], found[c]["radius"]) for c in sorted(found)], n)
    query_parts = max(1, -(-asked.count() // QUERY_BLOCK))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ASKED_AT_ONCE):  # a query may go to all cells
                yield _sent(batch.slice(lo, ASKED_AT_ONCE), vector, around)

    parts = F.create_map(*[F.lit(x) for c in found for x in (c, -(-found[c]["n"] // POOL_BLOCK))])
    part = lambda key, count: F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), count).cast("int")
    left = cells.drop("reach").withColumn("i", part(chunk_id, parts[F.col("cell")])).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    right = asked.mapInArrow(wanted, _with(asked, T.StructField("cell", T.IntegerType()))).withColumn("j", part(query_id, F.lit(query_parts))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)))

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        row, col, d = _best(_unit(_matrix(have[vector])), have[chunk_id], _unit(_matrix(want[vector])), n)
        return pa.table({query_id: want[query_id].take(pa.array(row)), "distance": pa.array(d), chunk_id: have[chunk_id].take(pa.array(col))})

    schema = _with(asked.select(query_id), T.StructField("distance", T.DoubleType()), pool.schema[chunk_id])
    at = ["cell", "i", "j"]
    best = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(search, schema)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", chunk_id))
    return best.withColumn("place", place).where(F.col("place") <= n)


#: Cells, and vectors of a block on either side; a vector is moved once for every block of the other side.
PIVOTS, POOL_BLOCK, QUERY_BLOCK = 32, 8192, 8192
#: Queries that are copied to their cells in one batch.
ASKED_AT_ONCE = 512
#: Distances that are held at once, whatever the size of a block.
DISTANCES = 1 << 19


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero stays zero."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length == 0, 1.0, length)


def _from_pivots(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((unit * unit).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * unit @ pivots.T)))


def _cells(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the way to it. Zero vectors, which are as far from all, have cell -1."""
    if not len(m):
        return np.zeros(0, np.int32), np.zeros(0)
    unit = _unit(m)
    ways = _from_pivots(unit, pivots)
    cell = ways.argmin(axis=1)
    return np.where((unit != 0).any(axis=1), cell, -1).astype(np.int32), ways[np.arange(len(m)), cell]


class Around:
    """The cells: (number, vectors, radius) each."""

    def __init__(self, pivots: np.ndarray, cells: list[tuple[int, int, float]], n: int):
        self.pivots, self.n = pivots, n
        self.cells, self.size = np.array([c for c, _, _ in cells], np.int32), np.array([s for _, s, _ in cells])
        self.radius = np.array([r for _, _, r in cells])

    def reachable(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold one of a row's n nearest."""
        if not len(m):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        unit = _unit(m)
        ways = _from_pivots(unit, self.pivots)[:, np.maximum(self.cells, 0)]
        # zero vectors are at cosine distance 1 of everything: square root of 2 on the scale of vectors of length one
        low = np.where(self.cells < 0, np.sqrt(2.0), ways - self.radius)
        high = np.where(self.cells < 0, np.sqrt(2.0), ways + self.radius)
        order = np.argsort(high, axis=1)
        enough = (np.cumsum(self.size[order], axis=1) >= self.n).argmax(axis=1)
        bound = np.take_along_axis(high, order, axis=1)[np.arange(len(m)), enough]
        if self.size.sum() < self.n:
            bound[:] = np.inf
        bound[~(unit != 0).any(axis=1)] = np.inf
        row, at = np.nonzero(low <= bound[:, None] + 1e-6)
        return row, self.cells[at]


def _sent(asked: pa.RecordBatch, vector: str, around: Around) -> pa.RecordBatch:
    """A row of ``asked`` for each cell that it has to reach."""
    row, cell = around.reachable(_matrix(asked[vector]))
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in asked.columns), pa.array(cell, pa.int32())], [*asked.schema.names, "cell"])


def _best(have: np.ndarray, ids: pa.ChunkedArray, want: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``want``, row of ``have``, distance) of the ``n`` nearest of each; ties go to the smaller id."""
    if not len(have) or not len(want):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    by_id = np.asarray(pc.sort_indices(ids))
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.arange(len(by_id))
    rows, cols, found = [], [], []
    step = max(1, DISTANCES // len(have))
    for lo in range(0, len(want), step):
        d = 1.0 - want[lo : lo + step] @ have.T
        last = np.partition(d, n - 1, axis=1)[:, n - 1 : n] if len(have) > n else np.full((len(d), 1), np.inf)
        q, k = np.nonzero(d <= last)
        order = np.lexsort((rank[k], d[q, k], q))
        q, k = q[order], k[order]
        first = np.searchsorted(q, np.arange(len(d)))
        keep = np.arange(len(q)) - first[q] < n
        rows.append(q[keep] + lo)
        cols.append(k[keep])
        found.append(d[q[keep], k[keep]])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(found)


def centroids(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per label: one small row per label and dimension is all that is shuffled."""
    parts = vectors.select(F.col(label).alias("query_id"), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def context_text(results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Numbered result texts of a query, separated by rules; at most the few results of the search."""
    part = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("source", F.lit("Unknown")),
                    F.lit(" "), F.coalesce("section", F.lit("")), F.lit("\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("place", part.alias("t"))))
    return results.groupBy(query_id).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def retrieval_scores(results: DataFrame, relevant_counts: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """Precision, recall, reciprocal rank and hit rate, averaged over queries.

    ``results`` has query, place and ``is_relevant``; ``relevant_counts`` has
    ``relevant`` per query and keeps queries without results in the average.
    """
    found = results.groupBy(query_id).agg(
        F.count_if("is_relevant").alias("hits"), F.min(F.when(F.col("is_relevant"), F.col("place"))).alias("first"))
    per = relevant_counts.join(found, query_id, "left").select(
        F.coalesce("hits", F.lit(0)).alias("hits"), "first", "relevant")
    return per.agg(
        F.avg(F.col("hits") / F.lit(float(k))).alias("precision_at_k"),
        F.avg(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)).alias("recall_at_k"),
        F.avg(F.when(F.col("first").isNotNull(), F.lit(1.0) / F.col("first")).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
