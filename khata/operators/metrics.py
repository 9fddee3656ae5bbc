"""Usage, latency and compliance figures over a metric log.

A log row is name (``latency.<op>``, ``error.<kind>``, ...), type, value and ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.operators.windows import null_safe_join


def latency_overall(log: DataFrame) -> DataFrame:
    v = F.when(F.col("type") == "latency", F.col("value"))
    return log.agg(F.count(v).alias("count"), *[
        F.coalesce(fn(v), F.lit(0.0)).alias(name) for fn, name in ((F.avg, "avg_ms"), (F.max, "max_ms"), (F.min, "min_ms"))])


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, width: float = 1.0) -> DataFrame:
    """Per key: ``n``, ``_sum``, ``_max``, ``_min`` and the exact value at a 1-based rank, for groups of any size.

    ``rank`` is an expression over ``n``, the group size. One pass counts the rows per distinct value. A first running sum
    goes over bands of values, of which a key has few, a second one over the values of each band; so no key is collected or
    sorted as a whole. Null keys are keys; null values do not count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    band = Window.partitionBy(*keys, "_b")
    inner = counts.withColumn("_b", F.floor(F.col("_v") / width)).select(
        "*", F.sum("_c").over(band.orderBy("_v")).alias("_in"))
    sums = inner.groupBy(*keys, "_b").agg(
        F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_v")).alias("_t"), F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    key = Window.partitionBy(*keys)
    placed = sums.select(
        *keys, "_b", "_s", F.sum("_s").over(key.orderBy("_b")).alias("_upto"), F.sum("_s").over(key).alias("n"),
        F.sum("_t").over(key).alias("_sum"), F.max("_hi").over(key).alias("_max"), F.min("_lo").over(key).alias("_min"))
    wanted = rank.cast("bigint") - (F.col("_upto") - F.col("_s"))
    hits = placed.withColumn("_w", wanted).where((F.col("_w") >= 1) & (F.col("_w") <= F.col("_s")))
    found = null_safe_join(inner, hits.drop("_s", "_upto"), [*keys, "_b"]).where(F.col("_in") >= F.col("_w"))
    return found.groupBy(*keys, "n", "_sum", "_max", "_min").agg(F.min("_v").alias(value))


def latency_by_operation(log: DataFrame) -> DataFrame:
    """Count, average, extremes and p95 per operation, in one pass over the log.

    p95 is the value at position int(n * 0.95) of the sorted values, counted from
    zero; below twenty values it is the maximum.
    """
    v = log.where(F.col("type") == "latency").select(F.replace(F.col("name"), F.lit("latency."), F.lit("")).alias("op"), "value")
    found = value_at_rank(v, ["op"], "value", F.when(F.col("n") >= 20, F.floor(F.col("n") * F.lit(0.95)) + 1).otherwise(F.col("n")))
    return found.select("op", F.col("n").alias("count"), (F.col("_sum") / F.col("n")).alias("avg_ms"), F.col("_max").alias("max_ms"),
                        F.col("_min").alias("min_ms"), F.col("value").alias("p95_ms"))


def compliance_by_type(log: DataFrame) -> DataFrame:
    v = log.where(F.col("type") == "compliance")
    return v.groupBy(F.replace(F.col("name"), F.lit("compliance."), F.lit("")).alias("issue_type")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total_amount"))


def usage(log: DataFrame) -> DataFrame:
    """Counters of the session in one row."""
    def named(prefix):
        return F.count_if(F.col("name").startswith(prefix))

    saved = F.sum(F.when(F.col("name") == "compliance.tax_savings", F.col("value").cast("decimal(18,4)")))
    seconds = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    return log.agg(
        named("query.").alias("queries_total"), named("error.").alias("errors_total"),
        F.count_if(F.col("name") == "data.file_processed").alias("files_processed"),
        named("compliance.").alias("compliance_issues_found"),
        F.coalesce(saved, F.lit(0)).cast("double").alias("total_tax_savings"),
        F.coalesce(seconds, F.lit(0)).cast("bigint").alias("session_seconds"), F.count(F.lit(1)).alias("metrics_count"))


def daily_monitor(log: DataFrame, slow_ms: float = 15000.0, error_share: float = 0.10) -> DataFrame:
    """Per day: calls, users, error rate, p99 latency and the alerts they raise."""
    day = log.withColumn("day", F.to_date("ts"))
    calls = day.groupBy("day").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("type") == "error").alias("errors"))
    p99 = value_at_rank(day.where(F.col("type") == "latency"), ["day"], "value", F.ceil(F.col("n") * F.lit(0.99)))
    out = calls.join(p99.select("day", F.col("value").alias("p99_ms")), "day", "left")
    rate = F.col("errors") / F.col("calls")
    return out.select("*", rate.alias("error_rate"), F.when(rate > error_share, "page").when(
        F.col("p99_ms") > slow_ms, "warning").otherwise("ok").alias("alert"))
