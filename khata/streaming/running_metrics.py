"""Usage and latency figures that grow with the event stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.session import shared_dir

FIGURES = ("window_start timestamp, name string, calls bigint, total decimal(38,4), max_value double, min_value double, "
           "late_calls bigint, batch_id bigint")
SEEN = "last_ts timestamp, batch_id bigint"


def run(log: DataFrame, path: str, checkpoint: str, width: str = "1 day", lateness: str = "2 days"):
    """Write what each batch of ``log`` (name, value, ts) adds to its windows, under its batch number.

    Figures of a window are sums and extremes, so what a batch adds can be kept apart and put together by :func:`latest`: no
    state is held, and a row counts however late it comes. Rows more than ``lateness`` behind the last time that earlier
    batches had seen are counted in ``late_calls``. A batch that is repeated after a failure overwrites its own folders.
    """
    spark = log.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        seen = _read(spark, f"{path}/seen", SEEN).where(F.col("batch_id") < batch_id).agg(F.max("last_ts")).first()[0]
        late = F.lit(False) if seen is None else F.col("ts") < F.lit(seen) - F.expr(f"INTERVAL {lateness}")
        value = F.col("value").cast("decimal(18,4)")
        added = batch.groupBy(F.window("ts", width)["start"].alias("window_start"), "name").agg(
            F.count(F.lit(1)).alias("calls"), F.sum(value).cast("decimal(38,4)").alias("total"), F.max("value").alias("max_value"),
            F.min("value").alias("min_value"), F.count_if(late).alias("late_calls"))
        added.write.mode("overwrite").parquet(f"{path}/added/batch_id={batch_id}")
        # last, as the mark that the batch is there
        batch.agg(F.max("ts").alias("last_ts")).write.mode("overwrite").parquet(f"{path}/seen/batch_id={batch_id}")

    query = (log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return query


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _together(added: DataFrame) -> DataFrame:
    return added.groupBy("window_start", "name").agg(
        F.sum("calls").alias("calls"), F.sum("total").cast("decimal(38,4)").alias("total"), F.max("max_value").alias("max_value"),
        F.min("min_value").alias("min_value"), F.sum("late_calls").alias("late_calls"))


def _complete(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """What all complete batches added, beginning with the last compaction, and the number of the last one."""
    seen = _read(spark, f"{path}/seen", SEEN)
    last = seen.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    compacted = _read(spark, f"{path}/compacted", FIGURES)
    upto = compacted.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    rest = _read(spark, f"{path}/added", FIGURES).where((F.col("batch_id") > upto) & (F.col("batch_id") <= last))
    return compacted.where(F.col("batch_id") == upto).unionByName(rest), last


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Figures of every window over all complete batches."""
    return _together(_complete(spark, path)[0])


def compact(spark: SparkSession, path: str) -> None:
    """Put what all complete batches added into one folder, from which :func:`latest` goes on; later batches stay as they are."""
    rows, last = _complete(spark, path)
    if last >= 0:
        whole = shared_dir(spark, "compacted")
        _together(rows).write.parquet(whole)  # read to the end before the folder of an equal compaction is replaced
        spark.read.parquet(whole).write.mode("overwrite").parquet(f"{path}/compacted/batch_id={last}")
