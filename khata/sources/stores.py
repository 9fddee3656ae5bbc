"""Written catalogs, metric logs, tenant profiles and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.rules import tenant_id
from khata.sources import snapshots

CATALOG = ("table_name string, source_file string, description string, data_type string, row_count bigint, "
           "columns array<struct<name:string,type:string,description:string>>, keywords array<string>, "
           "date_range struct<date_column:string,min_date:string,max_date:string,period_description:string>, "
           "unique_counts map<string,bigint>, null_percentages map<string,double>, numeric_sums map<string,double>, "
           "sample_rows array<map<string,string>>, example_queries array<string>, related_tables array<string>")
METRICS = "name string, type string, value double, timestamp timestamp, metadata map<string,string>"
PROFILE = ("customer_id string, company_name string, gstin string, email string, created_at string, last_accessed string, "
           "business_type string, turnover_category string, state_code string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The last written catalog, empty where there is none."""
    found = snapshots.read(spark, path, CATALOG)
    return spark.createDataFrame([], CATALOG) if found is None else found


def write_catalog(catalog: DataFrame, path: str) -> None:
    """A new snapshot; ``catalog`` may come from the same path, and readers keep the one that they have begun."""
    snapshots.write(catalog, path)


def upsert(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """Catalog with the rows of ``fresh`` added or in place of older ones."""
    return catalog.join(fresh.select("table_name"), "table_name", "left_anti").unionByName(fresh, allowMissingColumns=True)


def remove(catalog: DataFrame, table_name: str) -> DataFrame:
    return catalog.where(F.col("table_name") != table_name)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def read_profiles(spark: SparkSession, workspace: str) -> DataFrame:
    """Tenant profiles, one JSON file per tenant folder, by company; unreadable ones are left out."""
    raw = spark.read.schema(PROFILE).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{workspace}/*/profile.json")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return (raw.withColumn("customer_id", folder).withColumn("company_name", F.coalesce("company_name", "customer_id"))
            .orderBy("company_name"))


def for_tenant(df: DataFrame, customer_id: str) -> DataFrame:
    """Rows of one tenant. On data partitioned by customer_id this reads that partition only."""
    return df.where(F.col("customer_id") == tenant_id(F.lit(customer_id)))


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """A table of the catalog, in the warehouse or at ``path``."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
