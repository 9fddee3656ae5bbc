"""New files as a stream, with a manifest of what was loaded and of what could not be read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions.text import table_name_of
from khata.session import written
from khata.sources.csv_source import with_columns
from khata.sources.folder import GLOB, errors_of, file_name
from khata.sources.manifest import cells_at

FILES = "path string, modificationTime timestamp, length bigint, content binary"
LOADED = ("filename string, file_path string, file_size bigint, modified_time timestamp, table_name string, row_count bigint, "
          "error string, batch_id bigint")


def load_new_files(spark: SparkSession, folder: str, schema: T.StructType, dataset: str, checkpoint: str, wait: bool = True,
                   max_files: int = 1000):
    """Load all CSV files and workbooks that have not been seen. Columns go by name, headers are found file by file.

    A batch is some of the new files, by name only; CSV files are read as lines, so one may be of any size and is split over
    tasks. A batch writes its rows, then a line per file with its table, rows or error, below its own number; that line is
    what makes rows count (:func:`read_rows`). A batch that is repeated overwrites its own folders, so nothing counts twice. A
    file that cannot be read has its error in the manifest and does not stop the stream.

    Changed and deleted files do not come through a file stream; they are the business of :func:`manifest.incremental_load`.
    """
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", max_files).schema(FILES).load(folder).drop("content"))
    columns = {f.name: f.dataType.simpleString() for f in schema.fields}

    def load(batch: DataFrame, batch_id: int) -> None:
        listed = written(batch, "new-files")
        cells = cells_at(spark, [r["path"] for r in listed.select("path").collect()])  # at most max_files
        errors = written(errors_of(cells), "errors")
        sound = cells.where("error is null").join(errors.select("source_file"), "source_file", "left_anti")
        name = file_name(F.col("source_file"))
        rows = written(with_columns(sound, columns).withColumns({"source_table": table_name_of(name), "source_name": name}), "rows")
        rows.drop("source_file").hint("rebalance", "source_table").write.mode("overwrite").partitionBy("source_table").parquet(
            f"{dataset}/rows/batch_id={batch_id}")
        counts = rows.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("row_count"))
        files = listed.join(counts, "path", "left").join(errors.withColumnRenamed("source_file", "path"), "path", "left")
        files.select(file_name(F.col("path")).alias("filename"), F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                     F.col("modificationTime").alias("modified_time"), F.when(F.col("row_count") > 0, table_name_of(file_name(F.col("path")))).alias("table_name"),
                     F.coalesce("row_count", F.lit(0)).alias("row_count"), "error").coalesce(1).write.mode("overwrite").json(f"{dataset}/files/batch_id={batch_id}")

    query = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(load).start()
    if wait:
        query.awaitTermination()
    return query


def read_files(spark: SparkSession, dataset: str) -> DataFrame:
    """A line per file that came: table, rows or error, and batch. Empty before the first batch."""
    try:
        return spark.read.schema(LOADED).json(f"{dataset}/files")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOADED)


def read_rows(spark: SparkSession, dataset: str, schema: T.StructType) -> DataFrame:
    """Rows of all complete batches, with ``source_table`` and ``source_name``. A batch without its manifest does not count."""
    done = read_files(spark, dataset).select("batch_id").distinct()
    whole = T.StructType([*schema.fields, T.StructField("source_table", T.StringType()), T.StructField("source_name", T.StringType()),
                          T.StructField("batch_id", T.LongType())])
    try:
        rows = spark.read.schema(whole).parquet(f"{dataset}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType(whole.fields[:-1]))
    return rows.join(done, "batch_id", "left_semi").drop("batch_id")
