"""Reference dimensions: built-in constants or CSV files with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import clean_name, clean_name_py
from khata.sources import delimited

GOODS = ["pos", "hsn_code", "item_name", "category", "gst_rate", "cess_rate"]
SERVICES = ["pos", "sac_code", "service_name", "category", "gst_rate", "condition"]


def inline(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A constant frame as an inline table, so its size is known to the optimizer."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def goods_card(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    df = inline(spark, rows or fv.GOODS_CARD, GOODS)
    return df.withColumn("gst_rate", F.col("gst_rate").cast("decimal(6,2)"))


def services_card(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    df = inline(spark, rows or fv.SERVICES_CARD, SERVICES)
    return df.withColumn("gst_rate", F.col("gst_rate").cast("decimal(6,2)"))


def states(spark: SparkSession) -> DataFrame:
    return inline(spark, fv.STATES, ["code", "state_name", "state_type", "region"])


def msme_bands(spark: SparkSession) -> DataFrame:
    """Bands with their turnover interval: above ``over``, up to and including ``upto``."""
    rows, low = [], -1
    for pos, (band, turnover, investment) in enumerate(fv.MSME_BANDS, 1):
        rows.append((pos, band, low, turnover, investment))
        low = turnover
    df = inline(spark, [*rows, (len(rows) + 1, "large", low, None, None)],
                ["pos", "band", "over", "upto", "investment_limit"])
    return df.select("pos", "band", F.col("over").cast("bigint"), F.col("upto").cast("bigint"),
                     F.col("investment_limit").cast("bigint"))


def slabs(spark: SparkSession) -> DataFrame:
    return inline(spark, fv.SLABS, ["slab_name", "rate", "examples"])


def blocked_items(spark: SparkSession) -> DataFrame:
    return inline(spark, list(enumerate(fv.BLOCKED_ITEMS, 1)), ["sl_no", "item_description"])


def compliance_rules(spark: SparkSession) -> DataFrame:
    """All rule constants in one row."""
    rules = fv.COMPLIANCE_RULES
    return inline(
        spark,
        [(rules["payment_rule"], fv.PAYMENT_LIMIT_DAYS, rules["payment_penalty"],
          rules["blocked_rule"], rules["itc_rule"], rules["itc_deadline"])],
        ["payment_rule", "days_limit", "payment_penalty", "blocked_rule", "itc_rule", "itc_deadline"],
    ).withColumn("blocked_items", F.array(*[F.lit(i) for i in fv.BLOCKED_ITEMS]))


def read_dimension(spark: SparkSession, path: str, columns: list[str], key: str | None = None) -> DataFrame:
    """A dimension CSV, or a folder of some, with every column as text (codes keep their leading zeros).

    ``pos`` counts rows in the order of file names and lines, however the files are split. A header that lacks one of the
    ``columns`` ends the job. Files are counted up in one window, a row per file.
    """
    cells = delimited.or_raise(delimited.line_cells(delimited.file_lines(spark, path, recursive=False), skip=0))
    last = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    base = cells.groupBy("source_file").agg((F.max("row_no") + 1).alias("n")).select(
        "source_file", F.coalesce(F.sum("n").over(last), F.lit(0)).alias("base"))
    names = {c: clean_name_py(c) for c in columns}
    heads = delimited.file_headers(spark, path, recursive=False).select(F.transform(F.split("header_line", ","), clean_name).alias("h"))
    missing = heads.select(F.explode(F.array_except(F.array(*[F.lit(n) for n in names.values()]), "h")).alias("c")).agg(
        F.collect_set("c").alias("c")).first()["c"]
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))} in {path}")
    df = cells.join(base, "source_file").select(
        *[F.col("cells")[n].alias(c) for c, n in names.items()], (F.col("base") + F.col("row_no") + 1).cast("bigint").alias("pos"))
    return df.where(F.col(key).isNotNull()) if key else df
