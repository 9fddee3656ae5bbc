"""Files made out of the given tables, for the source queries."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.plans import standins as st
from khata.session import shared_dir, spread
from khata.sources.digests import file_system

#: Workbooks that one task makes.
BOOKS_PER_TASK = 10_000
ORDERS_CSV = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate DATE"


def orders_csv(spark: SparkSession, sf_dir: str) -> str:
    """Orders as plain CSV files with a header."""
    path = shared_dir(spark, "orders-csv")
    (st.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                  "CAST(o_orderdate AS DATE) AS o_orderdate")
     .write.option("header", True).csv(path))
    return path


def customer_files(spark: SparkSession, sf_dir: str) -> str:
    """A text file of all customers per nation, in a folder for each."""
    path = shared_dir(spark, "customer-files")
    rows = st.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat_ws(",", "c_custkey", "c_name").alias("value"))
    (rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value")
     .write.partitionBy("c_nationkey").text(path))
    return path


def mixed_folder(spark: SparkSession, sf_dir: str) -> str:
    """Customers per nation as a CSV file or a workbook; for every fourth nation a broken workbook too."""
    path = shared_dir(spark, "mixed-folder")
    rows = st.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")

    def write(pdf):
        nation, pdf = int(pdf["c_nationkey"].iloc[0]), pdf.sort_values("c_custkey")
        table = [["Cust Key", "Customer Name", "Nation"], *([int(k), n, nation] for k, n in zip(pdf["c_custkey"], pdf["c_name"]))]
        is_book = nation % 2 == 1
        text = "\n".join(",".join(map(str, row)) for row in table) + "\n"
        files = {f"nation-{nation}.{'xlsx' if is_book else 'csv'}": workbook_bytes(table) if is_book else text.encode()}
        if nation % 4 == 0:
            files[f"broken-nation-{nation}.xlsx"] = b"no workbook"
        system, folder, _ = file_system(path)
        system.create_dir(folder)
        for name, content in files.items():
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(content)
        return pdf[["c_nationkey"]].head(1)

    rows.groupBy("c_nationkey").applyInPandas(write, rows.select("c_nationkey").schema).write.format("noop").mode("overwrite").save()
    return path


def tenant_folders(spark: SparkSession, sf_dir: str) -> str:
    """A workspace with a folder and a profile per supplier; some profiles name no company, some cannot be read."""
    path = shared_dir(spark, "workspace")
    tenants = st.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")

    def write(batches):
        for pdf in batches:
            for key, name, state in zip(pdf["s_suppkey"], pdf["s_name"], pdf["s_nationkey"]):
                system, folder, _ = file_system(f"{path}/tenant_{key}")
                system.create_dir(folder)
                profile = {"company_name": None if key % 5 == 0 else name, "state_code": str(state)}
                with system.open_output_stream(f"{folder}/profile.json") as f:
                    f.write(b"{broken" if key % 7 == 3 else json.dumps(profile, indent=1).encode())
            yield pdf[["s_suppkey"]]

    tenants.mapInPandas(write, tenants.select("s_suppkey").schema).write.format("noop").mode("overwrite").save()
    return path


def messy_csv(spark: SparkSession, sf_dir: str) -> str:
    """A file per nation: title lines, a header, one line per customer, the header once more, an empty column."""
    path = shared_dir(spark, "messy-csv")
    customers = st.table(spark, sf_dir, "customer")
    header = "Cust Key,Customer  Name,Acct-Bal (Rs.),,Unnamed: 4"
    rows = customers.select("c_nationkey", F.lit(10).alias("part"), F.col("c_custkey").alias("i"), F.concat(
        F.col("c_custkey").cast("string"), F.lit(","), F.col("c_name"), F.lit(","),
        F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit(",,"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("value"))
    extra = F.array(
        F.when(F.col("c_nationkey") % 3 > 0, F.struct(F.lit(0).alias("part"), F.concat(F.lit("Ledger of nation "), F.col("c_nationkey")).alias("value"))),
        F.when(F.col("c_nationkey") % 3 > 1, F.struct(F.lit(1).alias("part"), F.lit("Period, 2021").alias("value"))),
        F.struct(F.lit(5).alias("part"), F.lit(header).alias("value")),
        F.struct(F.lit(20).alias("part"), F.lit("").alias("value")),
        F.struct(F.lit(21).alias("part"), F.lit("cust_key,customer_name,acct_bal_rs,,").alias("value")))
    heads = (customers.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array_compact(extra)).alias("e"))
             .select("c_nationkey", "e.part", F.lit(0).cast("bigint").alias("i"), "e.value"))
    (rows.unionByName(heads).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "part", "i")
     .select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path))
    return path


def workbook_bytes(rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A small .xlsx of texts and numbers."""
    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    body = "".join(f'<row r="{i}">' + "".join(cell(v) for v in r) + "</row>" for i, r in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   f'<Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def customer_workbooks(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """One small workbook per customer, as (path, content): title, blank row, header, one row."""
    def build(batches):
        for pdf in batches:
            yield pd.DataFrame({
                "path": [f"cust_{k}.xlsx" for k in pdf["c_custkey"]],
                "content": [workbook_bytes([["Statement"], [], ["Cust Key", "Customer Name", "Acct Bal"], [int(k), n, float(b)]])
                            for k, n, b in zip(pdf["c_custkey"], pdf["c_name"], pdf["c_acctbal"])]})

    customers = st.table(spark, sf_dir, "customer")
    customers = customers if which is None else customers.where(which)
    dealt, tasks = spread(customers, "c_custkey"), -(-customers.count() // BOOKS_PER_TASK)
    if tasks > dealt.rdd.getNumPartitions():  # a file of few bytes a row has few splits however many rows
        dealt = customers.repartition(tasks, "c_custkey")
    return dealt.select("c_custkey", "c_name", "c_acctbal").mapInPandas(build, "path string, content binary")


def mixed_files(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """CSV files of a hundred customers each, a workbook for every fiftieth customer, and a broken one, as a folder of that
    day. On day 2 every third CSV has changed, some files are gone, and the broken one still is."""
    customers = st.table(spark, sf_dir, "customer")
    block = F.floor(F.col("c_custkey") / 100)
    balance = F.col("c_acctbal").cast("decimal(12,2)") + F.when((block % 3 == 0) & F.lit(day == 2), 1).otherwise(0)
    line = F.concat_ws(",", F.col("c_custkey"), F.col("c_name"), balance.cast("decimal(12,2)"))
    tables = customers.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("rows"))
    tables = tables.where((F.col("block") % 5 != 1) | F.lit(day == 1)).select(
        F.format_string("/in/Ledger %d.csv", F.col("block")).alias("path"), F.concat_ws(
            "\n", F.lit("Customers of a block"), F.lit("Cust Key,Customer Name,Acct Bal"), F.col("rows.line")).cast("binary").alias("content"))
    books = customer_workbooks(spark, sf_dir, (F.col("c_custkey") % 50 == 0) & ((F.col("c_custkey") % 150 != 0) | F.lit(day == 1)))
    broken = customers.where("c_custkey = 1").select(F.lit("broken.xlsx").alias("path"), F.lit("no zip").cast("binary").alias("content"))
    files = tables.unionByName(books).unionByName(broken)
    return files.select("path", "content", F.octet_length("content").cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
