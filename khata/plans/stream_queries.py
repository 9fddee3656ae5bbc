"""Streams over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.plans import fixtures
from khata.plans import standins as st
from khata.plans.registry import query
from khata.session import shared_dir
from khata.streaming import ingest, running_metrics


@query("st1_new_files", """
SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY 1
""")
def st1_new_files(spark, d):
    """Orders as they come in three rounds, the last with files that cannot be read beside them."""
    folder, dataset, checkpoint = shared_dir(spark, "stream-orders"), shared_dir(spark, "stream-rows"), shared_dir(spark, "stream-check")
    orders, schema = st.table(spark, d, "orders"), T.StructType.fromDDL(fixtures.ORDERS_CSV)
    for part in range(3):
        some = orders.where(F.col("o_orderkey") % 3 == part).selectExpr(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "CAST(o_orderdate AS DATE) AS o_orderdate")
        some.write.option("header", True).csv(f"{folder}/{part}")
        if part == 2:
            some.limit(1).select(F.lit("no workbook").alias("value")).coalesce(1).write.text(f"{folder}/broken.xlsx")
        ingest.load_new_files(spark, folder, schema, dataset, checkpoint)
    ingest.load_new_files(spark, folder, schema, dataset, checkpoint)  # nothing new: the same files count once
    return ingest.read_rows(spark, dataset, schema).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"))


@query("st2_running_metrics", f"""
WITH log AS ({st.duck(st.METRICS_SQL)})
SELECT CAST(ts AS DATE) AS day, name, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, max(value) AS max_value, min(value) AS min_value
FROM log GROUP BY 1, 2
""")
def st2_running_metrics(spark, d):
    """The log as it comes in two rounds, the second with rows of all days, most of them later than the watermark."""
    log = spark.sql(st.METRICS_SQL, events=st.table(spark, d, "events")).select("name", "value", F.col("ts").cast("timestamp").alias("ts"))
    source, path, checkpoint = (shared_dir(spark, n) for n in ("metrics-log", "metrics", "metrics-check"))
    late = F.pmod(F.xxhash64("name", "ts", "value"), F.lit(3)) == 0
    for part, rows in enumerate((log.where(~late), log.where(late))):
        rows.write.parquet(f"{source}/{part}")
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet(source)
        running_metrics.run(stream, path, checkpoint)
        running_metrics.compact(spark, path)
    out = running_metrics.latest(spark, path)
    return out.select(F.to_date("window_start").alias("day"), "name", "calls", F.col("total").cast("double").alias("total"), "max_value", "min_value")
