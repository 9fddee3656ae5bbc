"""Messy CSV files of any size, read as lines, so that a file is split over tasks.

A quote counts at the start of a cell, so quoted commas and line breaks are kept, and stray quotes elsewhere are text.
Lines are gathered to chunks, which are written once. A chunk starts either outside or inside a quoted cell; where it ends is
known for both cases, so one pass over a few numbers a chunk tells how each starts and which rows are before it. Then chunks
are parsed apart from each other, and the rows that lie across chunks are put together from their pieces. Only such a row, or
a line, has to fit in memory.

Contents handed over as bytes (``file_cells``) are parsed by one task a file.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import clean_name_py
from khata.session import written

CELLS = "source_file string, row_no bigint, cells map<string,string>, error string"
_ARROW = pa.schema([("source_file", pa.string()), ("row_no", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
_ROWS_PER_BATCH = 5000
#: Bytes of files whose rows leave together.
_BYTES_PER_BATCH = 1 << 20
#: Characters of a chunk of lines.
CHUNK = 1 << 20
#: ``open_from_0`` and ``rows_from_0`` hold for a start outside quotes: whether the end is inside, and the rows that begin.
_CHUNKS = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("text", pa.string()), ("lines", pa.int64()),
                     ("open_from_0", pa.int32()), ("rows_from_0", pa.int64()), ("open_from_1", pa.int32()), ("rows_from_1", pa.int64())])
_CHUNK_COLUMNS = ("source_file string, block bigint, no bigint, text string, lines bigint, "
                  "open_from_0 int, rows_from_0 bigint, open_from_1 int, rows_from_1 bigint")


def decoded(content: bytes) -> str:
    return content.decode("utf-8-sig", "replace").replace("\0", "")


def header_line(text: str, look_at: int = fv.HEADER_SCAN_LINES) -> tuple[int, str]:
    """Number and text of the header: the first of the top lines with the most usual number of commas.

    Lines without commas do not count; of equally usual numbers the one seen first wins; a file without commas has its
    header in the first line.
    """
    top = [line.rstrip("\r\n") for line in itertools.islice(io.StringIO(text, newline=None), look_at)]
    counts = Counter(n for line in top if line.strip() and (n := line.count(",")))
    if not counts:
        return 0, top[0] if top else ""
    usual = counts.most_common(1)[0][0]  # the first seen of equals
    at = next(i for i, line in enumerate(top) if line.strip() and line.count(",") == usual)
    return at, top[at]


def table_rows(text: str, skip: int) -> Iterator[list[str | None]]:
    """The header and all rows below it, cells stripped, empty ones as None; blank lines go."""
    source = io.StringIO(text, newline="")
    whole = io.StringIO(text, newline=None)
    for _ in range(skip):
        whole.readline()
    source = io.StringIO(whole.read(), newline="")
    for row in csv.reader(source, skipinitialspace=True):
        if row:
            yield [c.strip() or None for c in row]


def column_names(header: list[str | None], filled: set[int] | None) -> list[str | None]:
    """Clean names of the columns that hold anything, None for the others.

    Columns without a usable name are called after their place among the kept ones; a repeated name gets a number.
    """
    names: list[str | None] = []
    place, seen = 0, Counter()
    for i, raw in enumerate(header):
        if filled is not None and i not in filled:
            names.append(None)
            continue
        name = clean_name_py(raw or "")
        if not name or name.startswith("unnamed"):
            name = f"col_{place}"
        place += 1
        names.append(f"{name}_{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return names


def doubtful(header: list[str | None]) -> bool:
    """Whether the names depend on which columns hold anything."""
    clean = [clean_name_py(h or "") for h in header]
    return len(set(clean)) < len(clean) or any(not c or c.startswith("unnamed") for c in clean)


def named(names: list[str | None], row: list[str | None]) -> list[tuple[str, str]]:
    """Name-value pairs of a row; none if it has no value or repeats the header."""
    pairs = [(n, c) for n, c in zip(names, row) if n is not None and c is not None]
    return pairs if any(c.lower() != n.lower() for n, c in pairs) else []


def parsed(content: bytes) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(row number, name-value pairs) of every row with a value that does not repeat the header."""
    csv.field_size_limit(1 << 30)
    text = decoded(content)
    skip = header_line(text)[0]
    header = next(table_rows(text, skip), [])
    filled = None
    if doubtful(header):
        filled = {i for row in itertools.islice(table_rows(text, skip), 1, None) for i, c in enumerate(row) if c is not None}
    names = column_names(header, filled)
    for no, row in enumerate(itertools.islice(table_rows(text, skip), 1, None)):
        if pairs := named(names, row):
            yield no, pairs


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def gathered(batches: Iterator[pa.RecordBatch], rows_of, broken, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows ``rows_of(path, content)`` of all files, those of many small files in one batch, and never a large file at once.

    A file that cannot be read gives the row ``broken(path, error)`` behind its rows so far.
    """
    rows, size = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            path, content = path.as_py(), content.as_py()
            try:
                for row in rows_of(path, content):
                    rows.append(row)
                    if len(rows) == _ROWS_PER_BATCH:
                        yield _made(rows, schema)
                        rows, size = [], 0
            except Exception as e:  # one bad file must not end the scan
                rows.append(broken(path, f"{type(e).__name__}: {e}"))
            size += len(content or b"")
            if rows and (size >= _BYTES_PER_BATCH or len(rows) >= _ROWS_PER_BATCH):
                yield _made(rows, schema)
                rows, size = [], 0
    if rows:
        yield _made(rows, schema)


def file_cells(files: DataFrame) -> DataFrame:
    """Rows of CSV files given as (path, content); a file that cannot be read is one row with its ``error``."""
    def rows_of(path, content):
        if content is None:
            raise ValueError("File without content")
        return ((path, no, pairs, None) for no, pairs in parsed(content))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(batches, rows_of, lambda path, error: (path, -1, None, error), _ARROW)

    return files.select("path", "content").mapInArrow(read, CELLS)


def file_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(source_file, block, line) of CSV files: ``block`` is where in the file a task began to read. A block's lines are in order."""
    reader = spark.read.format("text")
    reader = reader.option("recursiveFileLookup", True) if recursive else reader
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(_plain_path(F.col("_metadata.file_path")).alias("source_file"),
                                    F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _plain_path(encoded: Column) -> Column:
    """A path as ``binaryFile`` has it."""
    return F.regexp_replace(F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), "^([^:/]+):///", "$1:/")


def _rows(text: str, inside: bool = False) -> Iterator[tuple[list[str], int]]:
    """Rows of a text of whole lines and the lines that each takes; ``inside`` if the text starts within a quoted cell."""
    csv.field_size_limit(1 << 30)
    reader, before = csv.reader(io.StringIO(('"' if inside else "") + text, newline=""), skipinitialspace=True), 0
    for row in reader:
        yield row, reader.line_num - before
        before = reader.line_num


def _end(text: str, inside: bool) -> tuple[int, int]:
    """Whether the end of the text is within a quoted cell, and the rows that begin in it. A line added at the end tells."""
    rows, taken = 0, 1
    for row, taken in _rows(text + "\n.\n", inside):
        rows += bool(row)
    return int(taken > 1), rows - (taken == 1) - inside


def _chunk(path: str, block: int, no: int, lines: list[str]) -> tuple:
    text = "\n".join(lines)
    quoted = '"' in text
    return (path, block, no, text, len(lines), *(_end(text, False) if quoted else (0, sum(map(bool, lines)))), *(_end(text, True) if quoted else (1, 0)))


def file_chunks(lines: DataFrame) -> DataFrame:
    """The lines in chunks, numbered within their block. As many lines at the top of a block as may be looked at for a header
    are chunks of their own, so a chunk is above the header, or below it, or is its first line."""
    size = CHUNK

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, no, held, length = None, 0, [], 0
        for batch in batches:
            paths, blocks = batch["source_file"].dictionary_encode(), batch["block"].to_numpy()
            codes = paths.indices.to_numpy()
            starts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(codes)]
            out = []
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                place = (paths.dictionary[codes[a]].as_py(), int(blocks[a]))
                if place != at:
                    if held:
                        out.append(_chunk(*at, no, held))
                    at, no, held, length = place, 0, [], 0
                for line in batch["line"].slice(a, b - a).to_pylist():
                    held.append(line.decode("utf-8", "replace").replace("\0", ""))
                    length += len(held[-1]) + 1
                    if no < fv.HEADER_SCAN_LINES or length >= size:
                        out.append(_chunk(*at, no, held))
                        no, held, length = no + 1, [], 0
            if out:
                yield _made(out, _CHUNKS)
        if held:
            yield _made([_chunk(*at, no, held)], _CHUNKS)

    return lines.mapInArrow(read, _CHUNK_COLUMNS)


def _before(partition: str = "source_file"):
    return Window.partitionBy(partition).orderBy("block", "no").rowsBetween(Window.unboundedPreceding, -1)


def chunk_headers(chunks: DataFrame) -> DataFrame:
    """source_file, skip_rows and header_line of every file that has lines."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_line("".join(f"{line['text']}\n" for line in top)) for top in batch["top"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["source_file"], pa.array([f[0] for f in found], pa.int32()),
                                              pa.array([f[1] for f in found], pa.string())], ["source_file", "skip_rows", "header_line"])

    # the first lines of a file are among the first lines of its blocks, each of them a chunk
    first = chunks.where(F.col("no") < fv.HEADER_SCAN_LINES).withColumn("above", F.coalesce(F.sum("lines").over(_before()), F.lit(0)))
    sure = first.where(F.col("above") < fv.HEADER_SCAN_LINES)
    tops = sure.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("block", "no", "text"))).alias("top"))
    return tops.mapInArrow(read, "source_file string, skip_rows int, header_line string")


def placed(chunks: DataFrame, skip: int | None = None, spans: bool = True) -> DataFrame:
    """source_file, block and no of the chunks from the header on, with ``inside`` and ``open`` (whether the chunk starts and
    ends within a quoted cell), ``begun`` (the rows that begin in it) and ``base`` (those before it; the header is row 0).

    Without ``spans`` no chunk ends within a quoted cell, so none starts in one.
    """
    slim = chunks.drop("text").withColumn("above", F.coalesce(F.sum("lines").over(_before()), F.lit(0)))
    if skip is None:
        slim = slim.join(chunk_headers(chunks).select("source_file", F.col("skip_rows").alias("skip")), "source_file")
    else:
        slim = slim.withColumn("skip", F.lit(skip))
    if not spans:
        rows = slim.where("above >= skip").withColumns({"inside": F.lit(False), "open": F.lit(False), "begun": F.col("rows_from_0")})
        return rows.select("source_file", "block", "no", "inside", "open", "begun", F.coalesce(F.sum("begun").over(_before()), F.lit(0)).alias("base"))
    upto = Window.partitionBy("source_file").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, 0)
    # a chunk keeps, turns or sets what it starts with; turns are counted, and the last set value counts from there
    turn = (F.col("open_from_0") == 1) & (F.col("open_from_1") == 0)
    slim = slim.where("above >= skip").withColumn("turns", F.sum(turn.cast("int")).over(upto) % 2)
    sets = F.when(F.col("open_from_0") == F.col("open_from_1"), (F.col("open_from_0") + F.col("turns")) % 2)
    slim = slim.withColumn("sets", sets)
    slim = slim.withColumn("open", (F.coalesce(F.last("sets", True).over(upto), F.lit(0)) + F.col("turns")) % 2 == 1)
    slim = slim.withColumn("inside", F.coalesce(F.lag("open").over(Window.partitionBy("source_file").orderBy("block", "no")), F.lit(False)))
    slim = slim.withColumn("begun", F.when(F.col("inside"), F.col("rows_from_1")).otherwise(F.col("rows_from_0")))
    return slim.select("source_file", "block", "no", "inside", "open", "begun", F.coalesce(F.sum("begun").over(_before()), F.lit(0)).alias("base"))


def _stripped(row: list[str]) -> list[str | None]:
    return [c.strip() or None for c in row]


def _own_rows(chunk: dict) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of the rows that lie within a chunk as a whole."""
    no, last = chunk["base"], chunk["base"] + chunk["begun"] - chunk["open"]
    for row, _ in itertools.islice(_rows(chunk["text"], chunk["inside"]), int(chunk["inside"]), None):
        if row:
            if no >= last:
                return
            yield no, _stripped(row)
            no += 1


def _pieces(chunk: dict) -> Iterator[tuple[int, str]]:
    """Number and text of what a chunk holds of rows that began before it or end after it."""
    if chunk["inside"] and chunk["open"] and not chunk["begun"]:
        yield chunk["base"] - 1, chunk["text"]
        return
    lines = chunk["text"].split("\n")
    at, begun = 0, 0
    for i, (row, taken) in enumerate(_rows(chunk["text"], chunk["inside"])):
        piece = "\n".join(lines[at : at + taken])
        at += taken
        if chunk["inside"] and i == 0:
            yield chunk["base"] - 1, piece
        elif row:
            begun += 1
            if chunk["open"] and begun == chunk["begun"]:
                # an open row goes to the end of the chunk, blank last lines too
                yield chunk["base"] + begun - 1, "\n".join(lines[at - taken :])


def _over_chunks(chunks: DataFrame, of_chunk, schema: pa.Schema, columns: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = of_chunk(batch.slice(i, 1).to_pylist()[0])
                while some := list(itertools.islice(rows, _ROWS_PER_BATCH)):
                    yield _made(some, schema)

    return chunks.mapInArrow(read, columns)


def _across(chunks: DataFrame) -> DataFrame:
    """(source_file, number, text) of the rows that lie across chunks."""
    def cut(chunk):
        return ((chunk["source_file"], chunk["block"], chunk["no"], n, piece) for n, piece in _pieces(chunk))

    schema = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("number", pa.int64()), ("text", pa.string())])
    pieces = _over_chunks(chunks.where("inside or open"), cut, schema, "source_file string, block bigint, no bigint, number bigint, text string")
    whole = pieces.groupBy("source_file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "no", "text"))).alias("p"))
    return whole.select("source_file", "number", F.array_join(F.col("p.text"), "\n").alias("text"))


def line_cells(lines: DataFrame, skip: int | None = None) -> DataFrame:
    """Rows of CSV files given as lines (:func:`file_lines`), as :func:`file_cells` has them.

    ``skip`` is the number of lines above the header; by default it is found.
    """
    return chunk_cells(written(file_chunks(lines), "chunks"), skip)


def unclosed(places: DataFrame) -> DataFrame:
    """source_file and row number of files that end within a quoted cell; the row is that in which the quote opens."""
    at = F.struct("block", "no")
    return places.groupBy("source_file").agg(F.max_by("open", at).alias("open"), F.max(F.when(F.col("begun") > 0, F.col("base") + F.col("begun") - 1)).alias("row")
                                             ).where("open").select("source_file", "row")


def chunk_cells(chunks: DataFrame, skip: int | None = None) -> DataFrame:
    """Rows of the chunks of files. A file that ends within a quoted cell is one row with its error: what follows the quote, were
    it the rest of a large file, is never put together."""
    # files start outside of quotes; if no chunk leaves a quote open that it has not found open, none is ever within one
    spans = not chunks.where("open_from_0 <> 0").isEmpty()
    places = written(placed(chunks, skip, spans), "places")
    errors = None
    if spans:
        broken = written(unclosed(places), "unclosed")
        places = places.join(broken.select("source_file"), "source_file", "left_anti")
        errors = broken.select("source_file", F.lit(-1).cast("bigint"), F.lit(None).cast("map<string,string>"), F.concat(
            F.lit("Quote that is not closed in row "), F.col("row").cast("string")))
    sound = all_chunks = chunks.select("source_file", "block", "no", "text").join(places, ["source_file", "block", "no"])
    if spans:
        # a row across chunks is a chunk of one row
        one = _across(all_chunks).select("source_file", F.col("number").alias("block"), F.lit(0).cast("bigint").alias("no"), "text",
                                         F.lit(False).alias("inside"), F.lit(False).alias("open"), F.lit(1).cast("bigint").alias("begun"),
                                         F.col("number").alias("base"))
        sound = all_chunks.unionByName(one)

    def head(chunk):
        return ((chunk["source_file"], row, doubtful(row)) for n, row in itertools.islice(_own_rows(chunk), 1) if n == 0)

    schema = pa.schema([("source_file", pa.string()), ("header", pa.list_(pa.string())), ("doubtful", pa.bool_())])
    headers = written(_over_chunks(sound.where("base = 0"), head, schema, "source_file string, header array<string>, doubtful boolean"), "headers")
    if headers.where("doubtful").isEmpty():
        headers = headers.withColumn("used", F.lit(None).cast("array<int>"))
    else:
        def fill(chunk):
            used = {i for n, row in _own_rows(chunk) if n > 0 for i, c in enumerate(row) if c is not None}
            return ((chunk["source_file"], i) for i in used)

        some = sound.join(headers.where("doubtful").select("source_file"), "source_file", "left_semi")
        used = _over_chunks(some, fill, pa.schema([("source_file", pa.string()), ("i", pa.int32())]), "source_file string, i int")
        headers = headers.join(used.groupBy("source_file").agg(F.collect_set("i").alias("used")), "source_file", "left")

    def cells(chunk):
        names = column_names(chunk["header"], set(chunk["used"] or ()) if chunk["doubtful"] else None)
        return ((chunk["source_file"], n - 1, pairs, None) for n, row in _own_rows(chunk) if n > 0 and (pairs := named(names, row)))

    found = _over_chunks(sound.join(headers, "source_file"), cells, _ARROW, CELLS)
    return found if errors is None else found.union(errors)


def file_headers(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """source_file, skip_rows and header_line of every file."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("recursiveFileLookup", True) if recursive else reader
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.col("path").alias("source_file"))
    heads = chunk_headers(file_chunks(file_lines(spark, path, glob, recursive)))
    return files.join(heads, "source_file", "left").select(
        "source_file", F.coalesce("skip_rows", F.lit(0)).alias("skip_rows"), F.coalesce("header_line", F.lit("")).alias("header_line"))


def or_raise(cells: DataFrame) -> DataFrame:
    """The rows without ``error``; the job fails with the first error that there is."""
    message = F.concat("source_file", F.lit(": "), "error")
    return cells.where(F.when(F.col("error").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
