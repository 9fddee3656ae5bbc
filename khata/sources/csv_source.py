"""CSV scans: clean files, files with a preamble above the header, and whole folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions import fixed_values as fv
from khata.functions.text import clean_name, clean_name_py, file_extension
from khata.sources import delimited



def read_clean(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Files whose first line is the header; names are kept as they are.

    Give a schema for anything large: inferring it reads the files twice. A file
    whose header differs from the schema ends the job.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema).option("enforceSchema", False) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_by_extension(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by file extension; anything but CSV and workbooks is refused."""
    from khata.sources.workbook import read_workbooks
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext == ".csv":
        return read_messy(spark, path, **options)
    if ext == ".xlsx":
        return read_workbooks(spark, path, **options)
    raise ValueError(f"Unsupported file type: {ext}. Supported: .xlsx, .csv")


# --- files with anything above the header -------------------------------------------

def find_headers(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """source_file, skip_rows and header_line of every file."""
    return delimited.file_headers(spark, path, glob)


def column_names(header: Column, filled: Column) -> Column:
    """Clean names of the columns that hold anything, null for the others.

    Columns without a usable name are called after their place among the kept
    ones; a repeated name gets a number.
    """
    kept = F.transform(header, lambda h, i: F.struct(
        clean_name(F.coalesce(h, F.lit(""))).alias("name"),
        F.aggregate(F.slice(filled, F.lit(1), i), F.lit(0), lambda a, f: a + f.cast("int")).alias("at"),
        F.get(filled, i).alias("keep")))
    named = F.transform(kept, lambda k: F.when(k["keep"], F.when(
        (k["name"] == "") | k["name"].startswith("unnamed"), F.concat(F.lit("col_"), k["at"].cast("string"))
    ).otherwise(k["name"])))
    return F.transform(named, lambda n, i: F.when(
        F.array_contains(F.slice(named, F.lit(1), i), n),
        F.concat(n, F.lit("_"), F.size(F.filter(F.slice(named, F.lit(1), i), lambda o: o == n)).cast("string"))).otherwise(n))


def numbers_places(columns: dict[str, str] | None) -> bool:
    """Whether the wanted columns may include nameless ones, which are called after their place."""
    return columns is None or any(c.startswith("col_") for c in columns)


def tables_from_cells(rows: DataFrame, headers: DataFrame, count_filled: bool = True) -> DataFrame:
    """Rows of (source_file, cells) and headers of (source_file, header) to name -> text maps.

    Which columns hold anything only matters for naming nameless ones; without
    ``count_filled`` that extra pass over the rows is spared.
    """
    if count_filled:
        used = (rows.select("source_file", F.posexplode("cells").alias("i", "c")).where(F.col("c").isNotNull())
                .groupBy("source_file").agg(F.collect_set("i").alias("used")))
        headers = headers.join(used, "source_file").withColumn(
            "filled", F.transform("header", lambda h, i: F.array_contains("used", i)))
    else:
        headers = headers.withColumn("filled", F.transform("header", lambda h: F.lit(True)))
    named = headers.select("source_file", column_names(F.col("header"), F.col("filled")).alias("names"))
    return named_cells(rows.join(named, "source_file"))


def named_cells(rows: DataFrame) -> DataFrame:
    """Rows of names and cells to maps; rows without values and repeated headers go."""
    pairs = F.filter(F.arrays_zip(F.col("names"), F.col("cells")),
                     lambda p: p["names"].isNotNull() & p["cells"].isNotNull())
    repeated = F.forall("pairs", lambda p: F.lower(p["cells"]) == F.lower(p["names"]))
    return (rows.withColumn("pairs", pairs).where((F.size("pairs") > 0) & ~repeated)
            .select("source_file", F.map_from_entries("pairs").alias("cells")))


def read_messy(spark: SparkSession, path: str | list[str], columns: dict[str, str] | None = None,
               glob: str | None = None) -> DataFrame:
    """CSV files with any preamble, many files at once.

    Files may differ in header and columns, which go by name. The result has ``source_file`` and all columns that occur,
    as text, or those named in ``columns`` by their types. A value that does not fit its type is null. A file that cannot
    be read ends the job; ``folder.read_any`` lists it instead.
    """
    return with_columns(delimited.or_raise(delimited.line_cells(delimited.file_lines(spark, path, glob))), columns)


def with_columns(cells: DataFrame, columns: dict[str, str] | None) -> DataFrame:
    """Name -> text maps to typed columns; without ``columns`` the names that occur are the schema."""
    if columns is None:
        found = cells.select(F.explode(F.map_keys("cells")).alias("name")).distinct().orderBy("name").collect()
        columns = {r["name"]: "string" for r in found}
    return cells.select("source_file", *[
        F.col("cells")[name].try_cast(dtype).alias(name) for name, dtype in columns.items()])


# --- folders and cleaning ------------------------------------------------------------

def read_folder(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All CSV files of a folder as one frame with ``source_file``, columns by name whatever their order.

    A row with a value that does not fit its type keeps its values as text in ``_bad``.
    """
    cells = delimited.or_raise(delimited.line_cells(delimited.file_lines(spark, folder, "*.csv")))
    lower = {f.name: F.col("cells")[clean_name_py(f.name)] for f in schema.fields}
    typed = {n: v.try_cast(schema[n].dataType) for n, v in lower.items()}
    misfit = reduce(Column.__or__, [v.isNotNull() & typed[n].isNull() for n, v in lower.items()])
    return cells.select(*[v.alias(n) for n, v in typed.items()], F.when(misfit, F.to_json("cells")).alias("_bad"), "source_file")


def bad_lines(folder: DataFrame) -> DataFrame:
    """Lines, readable cells and unreadable lines per file."""
    data = [c for c in folder.columns if c not in ("_bad", "source_file")]
    cells = reduce(Column.__add__, [F.count(F.col(f"`{c}`")) for c in data])
    return folder.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"), cells.alias("cells"), F.count_if(F.col("_bad").isNotNull()).alias("bad_lines"))


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns by the column-name rule; nameless ones are called by their place."""
    names: list[str] = []
    for i, c in enumerate(df.columns):
        name = clean_name_py(c)
        name = f"col_{i}" if not name or name.startswith("unnamed") else name
        names.append(f"{name}_{names.count(name)}" if name in names else name)
    return df.toDF(*names)


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns without any value, found in one pass, then rows without any value."""
    filled = df.agg(*[(F.count(F.col(f"`{c}`")) > 0).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c]]).dropna(how="all")


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    """Drop rows whose values are just the column names."""
    same = F.lit(True)
    for c in df.columns:
        v = F.col(f"`{c}`")
        same = same & (v.isNull() | (F.lower(v.cast("string")) == c.lower()))
    return df.where(~same)


def header_issues(columns: DataFrame, first_rows: DataFrame | None = None) -> DataFrame:
    """Doubts about the header of each table.

    ``columns`` has table_name and column_name; ``first_rows`` may add the first
    data row as ``values``. Tables without issues have an empty list.
    """
    name = F.col("column_name")
    generic = name.startswith("unnamed") | name.startswith("col_") | name.startswith("column")
    by = columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(generic).alias("generic"),
        F.count_if(F.regexp_replace(name, "[_.]", "").rlike("^[0-9]+$")).alias("numeric"),
        F.count_if(F.length(name) > 50).alias("long"))
    checks = [
        F.when(F.col("generic") > F.col("n") * 0.3, F.concat(F.col("generic").cast("string"), F.lit(" columns have generic names (unnamed/col_)"))),
        F.when(F.col("numeric") > 0, F.concat(F.col("numeric").cast("string"), F.lit(" column names are numeric (may be data, not headers)"))),
        F.when(F.col("long") > 0, F.concat(F.col("long").cast("string"), F.lit(" column names are very long (>50 chars)"))),
    ]
    if first_rows is not None:
        by = by.join(first_rows, "table_name", "left")
        v = F.filter("values", lambda x: x.isNotNull())
        header_like = (F.forall(v, lambda x: (F.length(x) < 30) & ~F.replace(x, F.lit("."), F.lit("")).rlike("^[0-9]+$"))
                       & (F.size(F.array_distinct(v)) == F.size(v)) & (F.size(v) > 3))
        checks.append(F.when(header_like, F.lit("First data row looks like it might be headers")))
    issues = F.array_compact(F.array(*checks))
    return by.select("table_name", (F.size(issues) == 0).alias("valid"), issues.alias("issues"))


def is_accepted(filename: Column, size: Column) -> Column:
    """Allowed extension and at most 50 MB."""
    return file_extension(filename).isin(*fv.UPLOAD_EXTENSIONS) & (size <= fv.UPLOAD_LIMIT_BYTES)


def refusal(filename: Column, size: Column) -> Column:
    """Why a file is not accepted, empty if it is."""
    ext = file_extension(filename)
    return (F.when(~ext.isin(*fv.UPLOAD_EXTENSIONS), F.concat(F.lit("Invalid file type: "), ext, F.lit(". Allowed: .csv, .xls, .xlsx")))
             .when(size > fv.UPLOAD_LIMIT_BYTES, F.format_string(
                 "File too large: %.1fMB. Max: 50MB", size.cast("double") / F.lit(1024.0) / F.lit(1024.0)))
             .otherwise(""))
