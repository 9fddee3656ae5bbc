"""Workbook scans: one task reads one .xlsx file, everything after that is a DataFrame job."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import strip
from khata.session import written
from khata.sources.csv_source import numbers_places, tables_from_cells, with_columns
from khata.sources.delimited import gathered

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "source_file string, row_no int, cells array<string>, texts array<boolean>, error string"
_ARROW = pa.schema([("source_file", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("texts", pa.list_(pa.bool_())),
                    ("error", pa.string())])


def _sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f".//{_NS}sheet")
    chosen = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
    if chosen is None:
        raise ValueError(f"no sheet {sheet!r}")
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == chosen.get(f"{_REL}id"):
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("sheet without a part")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt")
             if re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    dated |= set(range(14, 18)) | {22}
    formats = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dated}


def _cell(c, shared: list[str], dates: set[int]) -> tuple[str | None, bool]:
    kind, value = c.get("t"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t")), True
    if value is None or value.text is None:
        return None, False
    if kind == "s":
        return shared[int(value.text)], True
    if kind == "str":
        return value.text, True
    if kind is None and int(c.get("s", -1)) in dates:
        day = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value.text))
        return day.date().isoformat() if day.time() == dt.time(0) else day.isoformat(sep=" "), False
    return value.text, False


def _column_no(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _shared_strings(book: zipfile.ZipFile) -> Iterator[str]:
    """The texts that cells refer to, streamed out of the zip; no tree of them is held."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return
    with book.open("xl/sharedStrings.xml") as part:
        root = None
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            root = e if root is None else root
            if event == "end" and e.tag == f"{_NS}si":
                yield "".join(t.text or "" for t in e.iter(f"{_NS}t"))
                root.clear()


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list, list]]:
    """(row number, texts, is-text flags) of one sheet, streamed out of the zip."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = list(_shared_strings(book))
        dates = _date_styles(book)
        with book.open(_sheet_path(book, sheet)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_NS}row":
                    continue
                values: list = []
                for c in row.findall(f"{_NS}c"):
                    at = _column_no(c.get("r")) if c.get("r") else len(values)
                    values += [(None, False)] * (at - len(values))
                    values.append(_cell(c, shared, dates))
                yield int(row.get("r", 0)) - 1, [v for v, _ in values], [t for _, t in values]
                row.clear()


def workbook_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Cells of workbooks given as (path, content); rows leave in batches, never a file at once, many small files together.

    A workbook that is broken or lacks the sheet is one row with its ``error`` and number -1.
    """
    def rows_of(path, content):
        return ((path, no, cells, texts, None) for no, cells, texts in sheet_rows(content, sheet))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(batches, rows_of, lambda path, error: (path, -1, None, None, error), _ARROW)

    return files.select("path", "content").mapInArrow(read, CELLS)


def header_scores(cells: DataFrame, look_at: int = fv.HEADER_SCAN_LINES) -> DataFrame:
    """How much each of the first rows of a sheet looks like a header.

    The windows only ever see the first ``look_at`` rows of a sheet.
    """
    sheet = Window.partitionBy("source_file")
    earlier = sheet.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.filter(F.arrays_zip("cells", "texts"), lambda p: p["cells"].isNotNull() & (p["cells"] != ""))
    texts = F.transform(F.filter("v", lambda p: p["texts"]), lambda p: strip(p["cells"]))
    top = (cells.where(F.col("row_no").between(0, look_at - 1)).withColumn("v", filled).withColumn("t", texts)
           .withColumn("n", F.size("v").cast("double")).withColumn("s", F.size("t"))
           .withColumn("width", F.max(F.size("cells")).over(sheet))
           .withColumn("after_sparse", F.coalesce(F.max(F.col("n") <= 2).over(earlier), F.lit(False))))

    def count(test):
        return F.size(F.filter("t", test))

    def is_number(x):
        return F.regexp_replace(x, "[.,]", "").rlike("^[0-9]+$")

    def is_mixed(x):
        return x.contains("_") | ((x != F.lower(x)) & (x != F.upper(x)))

    n = F.col("n")
    score = (n / F.col("width") * 20 + F.col("s") / n * 25 + count(lambda x: F.length(x) <= 30) / n * 20
             - count(lambda x: F.length(x) > 60) * 5
             + F.when(F.col("s") > 0, F.size(F.array_distinct(F.transform("t", F.lower))) / F.col("s") * 15).otherwise(0)
             + F.when(F.col("after_sparse"), 10).otherwise(0) - count(is_number) * 8 + count(is_mixed) * 2)
    return top.select("source_file", "row_no", "cells", F.when(n > 2, score).otherwise(-1.0).alias("score"))


def header_rows(cells: DataFrame) -> DataFrame:
    """The best scoring row of each sheet, the first of equals; the first row where none scores."""
    good = F.col("score") > -1
    rank = F.struct(good.alias("good"), F.when(good, F.col("score")).alias("score"), (-F.col("row_no")).alias("r"))
    best = header_scores(cells).groupBy("source_file").agg(F.max_by(F.struct("row_no", "cells"), rank).alias("h"))
    return best.select("source_file", F.col("h.row_no").alias("header_row"), F.col("h.cells").alias("header"))


def named_sheet_cells(cells: DataFrame, count_filled: bool = True) -> DataFrame:
    """(source_file, cells) with name -> text maps. Workbooks with an error are left out.

    ``cells`` is read several times here; hand in a written frame, not the parsing plan itself.
    """
    def texts(c):
        return F.transform(c, lambda x: F.nullif(strip(x), F.lit("")))

    sound = cells.join(cells.where("error is not null").select("source_file").distinct(), "source_file", "left_anti")
    heads = header_rows(sound)
    body = (sound.join(heads.select("source_file", "header_row"), "source_file")
            .where(F.col("row_no") > F.col("header_row")).select("source_file", texts(F.col("cells")).alias("cells")))
    headers = heads.select("source_file", texts(F.col("header")).alias("header"))
    return tables_from_cells(body, headers, count_filled)


def tables_from_workbooks(cells: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    return with_columns(named_sheet_cells(cells, numbers_places(columns)), columns)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None,
                   columns: dict[str, str] | None = None) -> DataFrame:
    """Workbooks below ``path``: first or named sheet, header found, cleaned. One that cannot be read is an error;
    ``folder.read_any`` reads the others and lists it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    cells = written(workbook_cells(files, sheet), "cells")
    if broken := cells.where("error is not null").select("source_file", "error").first():
        raise ValueError(f"{broken['source_file']}: {broken['error']}")
    return tables_from_workbooks(cells, columns)
