"""File manifests and what changed between two of them; incremental loading."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.text import table_name_of
from khata.session import written
from khata.sources import csv_source, delimited, snapshots
from khata.sources.csv_source import with_columns
from khata.sources.digests import DATA_FILES, file_digests
from khata.sources.folder import cells_of_files, errors_of, file_name

MANIFEST = ("filename string, file_path string, file_hash string, file_size bigint, modified_time timestamp, "
            "last_loaded timestamp, table_name string, sheet_type string, row_count bigint, stored_in string")
#: Files of one load up to which each has a folder of its own in the dataset; the rows of more go to one pool, as making, moving
#: and listing a folder for every small file would be most of the work.
FOLDERS = 200
#: Folder of the pools, hidden from readers of the folders of tables.
POOLS = "_pools"


def describe(files: DataFrame, with_hash: bool = True) -> DataFrame:
    hashed = [F.md5("content").alias("file_hash")] if with_hash else []
    return files.select(file_name(F.col("path")).alias("filename"), F.col("path").alias("file_path"), *hashed,
                        F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_time"))


def scan_files(spark: SparkSession, folder: str, with_hash: bool = True, recursive: bool = False,
               globs: tuple[str, ...] = DATA_FILES) -> DataFrame:
    """Data files of a folder: name, path, MD5, size and time, for files of any size. Without the hash no content is read."""
    found = file_digests(spark, folder, globs, with_hash, recursive)
    columns = ["file_hash"] if with_hash else []
    return found.select(file_name(F.col("path")).alias("filename"), F.col("path").alias("file_path"), *columns,
                        F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_time"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """NEW, DELETED, MODIFIED or UNCHANGED per file name, by content hash."""
    o = old.select("filename", F.col("file_hash").alias("old_hash"), "table_name")
    n = new.select("filename", F.col("file_hash").alias("new_hash"))
    both = o.withColumn("_o", F.lit(True)).join(n.withColumn("_n", F.lit(True)), "filename", "full")
    change = (F.when(F.col("_o").isNull(), "NEW").when(F.col("_n").isNull(), "DELETED")
               .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "MODIFIED").otherwise("UNCHANGED"))
    reason = (F.when(F.col("change") == "NEW", "New file detected").when(F.col("change") == "DELETED", "File no longer exists")
               .when(F.col("change") == "MODIFIED", "File contents changed").otherwise("No changes"))
    return both.withColumn("change", change).withColumn("reason", reason).drop("_o", "_n")


def load_plan(changes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Files to load: new and modified ones, and unchanged ones whose table is gone."""
    plan = changes.where(F.col("change").isin("NEW", "MODIFIED")).select("filename", "change")
    if tables is None:
        return plan
    kept = changes.where((F.col("change") == "UNCHANGED") & F.col("table_name").isNotNull())
    return plan.unionByName(lost_tables(kept, tables).select("filename", F.lit("NEW").alias("change")))


def lost_tables(loaded: DataFrame, tables: DataFrame) -> DataFrame:
    """Of the ``loaded`` files those whose table is gone."""
    return loaded.join(tables.select("table_name"), "table_name", "left_anti")


def tables_to_drop(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("change") == "DELETED") & F.col("table_name").isNotNull()).select("table_name")


def summary(changes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Counts per kind of change and whether anything needs reloading."""
    flagged = changes
    lost = F.lit(False)
    if tables is not None:
        have = tables.select(F.col("table_name").alias("_t")).distinct()
        flagged = changes.join(have, F.col("table_name") == F.col("_t"), "left")
        lost = F.col("table_name").isNotNull() & F.col("_t").isNull()
    n = lambda c: F.count_if(F.col("change") == c)
    return flagged.agg(
        F.count_if(F.col("change") != "DELETED").alias("total_files"), F.count_if(F.col("change") != "NEW").alias("loaded_files"),
        n("NEW").alias("new_files"), n("MODIFIED").alias("modified_files"), n("DELETED").alias("deleted_files"),
        F.coalesce(F.bool_or((F.col("change") != "UNCHANGED") | lost), F.lit(False)).alias("needs_reload"))


def loaded_manifest(manifest: DataFrame) -> DataFrame:
    """The entries of files that became tables."""
    return manifest.where(F.col("table_name").isNotNull() & (F.col("table_name") != ""))


def loaded_tables(manifest: DataFrame) -> DataFrame:
    return loaded_manifest(manifest).select("filename", "table_name")


def forget(manifest: DataFrame, filenames: DataFrame) -> DataFrame:
    return manifest.join(filenames.select("filename"), "filename", "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last written manifest; empty where there is none or where a line cannot be read."""
    empty = spark.createDataFrame([], MANIFEST)
    raw = snapshots.read(spark, path, MANIFEST + ", _bad string", columnNameOfCorruptRecord="_bad")
    if raw is None:  # a plain file of lines, as other programs write it
        try:
            raw = spark.read.schema(MANIFEST + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/*.json")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty
    broken = raw.agg(F.coalesce(F.bool_or(F.col("_bad").isNotNull() | F.col("filename").isNull()), F.lit(False))).scalar()
    return raw.where(~broken).drop("_bad")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A new snapshot of the manifest; ``manifest`` may come from the same path."""
    snapshots.write(manifest, path)


def accepted(files: DataFrame) -> DataFrame:
    return files.where(csv_source.is_accepted(F.col("filename"), F.col("file_size")))


def listing(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files with size, time, and the table they became, by name."""
    named = files.withColumn("_t", table_name_of(F.col("filename")))
    rows = catalog.select("table_name", "row_count")
    return (named.join(rows, F.col("_t") == F.col("table_name"), "left")
            .select(F.col("filename").alias("name"), F.round(F.col("file_size") / F.lit(1024.0), 2).alias("size_kb"),
                    F.col("modified_time").alias("modified"), "table_name", "row_count").orderBy("name"))


def incremental_load(spark: SparkSession, folder: str, dataset: str, old_manifest: str, new_manifest: str,
                     columns: dict[str, str] | None = None) -> DataFrame:
    """Load what changed in ``folder`` into ``dataset``, write the new manifest, and return the changes with errors.

    Files may be of any size: they are hashed as streams, and CSV files are read as lines, each split over many tasks. The
    manifests may be one path. See :func:`load_files` for what is loaded.
    """
    now = written(scan_files(spark, folder), "files")
    return _load(spark, now, dataset, old_manifest, new_manifest, columns, lambda plan: cells_at(spark, [
        r["file_path"] for r in now.join(plan, "filename", "left_semi").select("file_path").collect()]))


def cells_at(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, cells, error) of the files at ``paths``, by extension; see :func:`folder.cells_of_files`."""
    named = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]  # names, not patterns
    tables, others = ([p for p in named if p.lower().endswith(".csv") == is_csv] for is_csv in (True, False))
    books = spark.read.format("binaryFile").load(others) if others else spark.createDataFrame([], "path string, content binary")
    cells = cells_of_files(books.select("path", "content"))
    if tables:
        lines = delimited.line_cells(delimited.file_lines(spark, tables, recursive=False))
        cells = cells.unionByName(lines.select("source_file", "cells", "error"))
    return cells


def load_files(files: DataFrame, dataset: str, old_manifest: str, new_manifest: str,
               columns: dict[str, str] | None = None) -> DataFrame:
    """The same for ``files`` as (path, content, length, modificationTime): CSV files and workbooks.

    New and changed files are loaded, and unchanged ones whose table is gone from the dataset. All columns are kept, as
    text, unless ``columns`` names some. A load of up to ``FOLDERS`` files has a partition per table and file, so files whose
    names give one table name do not touch each other; only partitions of loaded files are rewritten. A load of more files is
    a pool that is written once, and the manifest has its name in ``stored_in``; rows that a later load replaces stay behind
    there. :func:`open_dataset` reads just what the manifest names. A file that cannot be read has its ``error`` in the result and is not in the new manifest, so
    the next run tries it again.
    """
    def cells(plan: DataFrame) -> DataFrame:
        wanted = files.withColumn("filename", file_name(F.col("path"))).join(plan.select("filename"), "filename", "left_semi")
        return cells_of_files(wanted.select("path", "content"))

    return _load(files.sparkSession, written(describe(files), "files"), dataset, old_manifest, new_manifest, columns, cells)


def _load(spark: SparkSession, now: DataFrame, dataset: str, old_manifest: str, new_manifest: str, columns: dict[str, str] | None, cells_of) -> DataFrame:
    old = read_manifest(spark, old_manifest)
    changes = written(detect_changes(old, now), "changes")
    plan = written(load_plan(changes, held_tables(spark, dataset, old)), "plan")
    cells = cells_of(plan)
    errors = errors_of(cells).select(file_name(F.col("source_file")).alias("filename"), "error")
    name = file_name(F.col("source_file"))
    sound = cells.where("error is null").join(cells.where("error is not null").select("source_file"), "source_file", "left_anti")
    rows = with_columns(sound, columns).withColumns({"source_table": table_name_of(name), "source_name": name})
    # rebalance keeps the files of a table together and splits large tables
    rows, pool = rows.hint("rebalance", "source_table"), None
    if plan.count() > FOLDERS:
        pool = f"load-{uuid.uuid4().hex}"
        rows.write.parquet(_pool_path(dataset, pool))
    else:
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source_table", "source_name").parquet(dataset))
    counts = sound.groupBy(name.alias("filename")).agg(F.count(F.lit(1)).alias("row_count"))
    # a file without rows leaves no table behind
    fresh = (plan.select("filename").join(now, "filename").join(errors, "filename", "left_anti").join(counts, "filename", "left").select(
        "filename", "file_path", "file_hash", "file_size", "modified_time", F.current_timestamp().alias("last_loaded"),
        F.when(F.col("row_count") > 0, table_name_of(F.col("filename"))).alias("table_name"),
        F.lit(None).cast("string").alias("sheet_type"), "row_count", F.lit(pool).cast("string").alias("stored_in")))
    gone = changes.where(F.col("change").isin("DELETED", "MODIFIED")).select("filename")
    write_manifest(forget(old, gone.unionByName(plan.select("filename"))).unionByName(fresh), new_manifest)
    return changes.join(errors, "filename", "left")


def _pool_path(dataset: str, pool: str) -> str:
    return f"{dataset}/{POOLS}/stored_in={pool}"


def _pools(manifest: DataFrame) -> list[str]:
    """The pools that the manifest names, at most one a load."""
    if "stored_in" not in manifest.columns:
        return []
    return sorted(r["stored_in"] for r in loaded_manifest(manifest).where("stored_in is not null").select("stored_in").distinct().collect())


def stored_tables(spark: SparkSession, dataset: str) -> DataFrame:
    """Tables that have folders in the dataset, by their names; none where there is no dataset. No row is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(dataset)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "table_name string")
    name = F.url_decode(F.regexp_extract("path", "/source_table=([^/]*)/", 1))
    return files.select(name.alias("table_name")).where("table_name <> ''").distinct()


def held_tables(spark: SparkSession, dataset: str, manifest: DataFrame) -> DataFrame:
    """Tables of the manifest that the dataset holds in every place that the manifest names for them."""
    held = stored_tables(spark, dataset).withColumn("stored_in", F.lit(None).cast("string"))
    for pool in _pools(manifest):
        try:
            tables = spark.read.schema("source_table string").parquet(_pool_path(dataset, pool)).select(F.col("source_table").alias("table_name"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        held = held.unionByName(tables.distinct().withColumn("stored_in", F.lit(pool)))
    named = loaded_manifest(manifest).select("table_name", "stored_in").distinct()
    have = held.select(F.col("table_name").alias("_t"), F.col("stored_in").alias("_s"))
    gone = named.join(have, (F.col("table_name") == F.col("_t")) & F.col("stored_in").eqNullSafe(F.col("_s")), "left_anti")
    return named.select("table_name").distinct().join(gone.select("table_name"), "table_name", "left_anti")


def open_dataset(spark: SparkSession, dataset: str, manifest: DataFrame) -> DataFrame:
    """Rows of the files the manifest names, from their folders and pools; the join prunes the partitions of all others."""
    have = loaded_manifest(manifest)
    names = have.select(F.col("table_name").alias("source_table"), F.col("filename").alias("source_name"),
                        F.col("stored_in") if "stored_in" in have.columns else F.lit(None).cast("string").alias("stored_in")).distinct()
    pools, in_folders, keys = _pools(manifest), names.where("stored_in is null"), ["source_table", "source_name"]
    rows = None
    if pools:
        found = spark.read.option("mergeSchema", True).option("basePath", f"{dataset}/{POOLS}").parquet(*[_pool_path(dataset, p) for p in pools])
        rows = found.join(names, [*keys, "stored_in"], "left_semi").drop("stored_in")
    if not pools or not in_folders.isEmpty():
        found = spark.read.option("mergeSchema", True).parquet(dataset).join(in_folders, keys, "left_semi")
        rows = found if rows is None else rows.unionByName(found, allowMissingColumns=True)
    return rows


def remove_file(manifest: DataFrame, catalog: DataFrame, filename: str) -> tuple[DataFrame, DataFrame]:
    """Manifest and catalog without a file; removing the file itself stays with the caller."""
    table = table_name_of(F.lit(filename))
    return manifest.where(F.col("filename") != filename), catalog.where(F.col("table_name") != table)
