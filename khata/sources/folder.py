"""Folders of CSV files and workbooks together: what can be read, and what cannot with its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.text import file_extension
from khata.session import written
from khata.sources import csv_source, delimited, workbook

GLOB = "*.{csv,xlsx,xls}"


def files_in(spark: SparkSession, folder: str, glob: str = GLOB) -> DataFrame:
    """path, modificationTime, length and content of all data files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def cells_of_files(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(source_file, cells, error) of all ``files`` (path, content), read by extension and written once.

    A file that is broken or of a kind that is not read is one row with its error.
    """
    kind = file_extension(file_name(F.col("path")))
    tables = delimited.file_cells(files.where(kind == ".csv")).select("source_file", "cells", "error")
    books = written(workbook.workbook_cells(files.where(kind == ".xlsx"), sheet), "cells")
    sheets = workbook.named_sheet_cells(books).select("source_file", "cells", F.lit(None).cast("string").alias("error"))
    broken = books.where("error is not null").select("source_file", F.lit(None).cast("map<string,string>").alias("cells"), "error")
    other = files.where(~kind.isin(".csv", ".xlsx")).select(
        F.col("path").alias("source_file"), F.lit(None).cast("map<string,string>").alias("cells"),
        F.concat(F.lit("Unsupported file type: "), kind).alias("error"))
    return written(tables.unionByName(sheets).unionByName(broken).unionByName(other), "folder")


def errors_of(cells: DataFrame) -> DataFrame:
    """source_file and error of what could not be read."""
    return cells.where("error is not null").groupBy("source_file").agg(F.first("error").alias("error"))


def read_any(spark: SparkSession, folder: str, columns: dict[str, str] | None = None,
             sheet: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a folder. Rows have ``source_file`` and all columns that occur, as text, or those named.

    A file with an error gives no rows. CSV files are read as lines, so they may be of any size.
    """
    tables = delimited.line_cells(delimited.file_lines(spark, folder, "*.csv", recursive=False))
    others = cells_of_files(files_in(spark, folder, "*.{xlsx,xls}"), sheet)
    cells = tables.select("source_file", "cells", "error").unionByName(others)
    errors = errors_of(cells)
    sound = cells.where("error is null").join(errors, "source_file", "left_anti")
    return csv_source.with_columns(sound, columns), errors
