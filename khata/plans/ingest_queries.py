"""Sources: CSV and workbook scans, manifests, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions import text as tx
from khata.plans import fixtures
from khata.plans import standins as st
from khata.plans.duck import strip
from khata.plans.registry import query
from khata.session import shared_dir, written
from khata.sources import csv_source, folder, manifest, stores, workbook

_BY_STATUS = """
SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total,
       min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY 1
"""


def _by_status(df):
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"),
        F.min("o_orderdate").alias("first_day"))


@query("s1_clean_csv", _BY_STATUS)
def s1_clean_csv(spark, d):
    return _by_status(csv_source.read_clean(spark, fixtures.orders_csv(spark, d), fixtures.ORDERS_CSV))


@query("s7_csv_folder", "SELECT count(*) AS orders, count(*) * 5 AS cells, CAST(0 AS BIGINT) AS bad_lines FROM orders")
def s7_csv_folder(spark, d):
    schema = T.StructType.fromDDL(fixtures.ORDERS_CSV)
    folder = csv_source.read_folder(spark, fixtures.orders_csv(spark, d), schema)
    return csv_source.bad_lines(folder).agg(F.sum("lines").alias("orders"), F.sum("cells").alias("cells"), F.sum("bad_lines").alias("bad_lines"))


@query("s7_mixed_folder", """
SELECT 'rows' AS what, concat('nation ', c_nationkey) AS source, count(*) AS n, sum(c_custkey) AS keys FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'error', concat('nation ', c_nationkey), count(*), 0 FROM customer WHERE c_nationkey % 4 = 0 GROUP BY c_nationkey
""")
def s7_mixed_folder(spark, d):
    """Customers as CSV files and workbooks, one per nation, beside files that cannot be read; those are listed."""
    rows, errors = folder.read_any(spark, fixtures.mixed_folder(spark, d), {"cust_key": "bigint"})
    nation = F.concat(F.lit("nation "), F.regexp_extract("source_file", r"nation-(\d+)", 1)).alias("source")
    found = rows.groupBy(nation).agg(F.count("*").alias("n"), F.sum("cust_key").alias("keys"))
    listed = errors.groupBy(nation).agg(F.count_if(F.col("error").isNotNull()).alias("files"))
    # a broken file stands for all customers of its nation
    sizes = st.table(spark, d, "customer").groupBy(F.concat(F.lit("nation "), "c_nationkey").alias("source")).agg(F.count("*").alias("n"))
    return found.select(F.lit("rows").alias("what"), "source", "n", "keys").unionByName(
        listed.where("files = 1").join(sizes, "source").select(F.lit("error").alias("what"), "source", "n", F.lit(0).cast("bigint").alias("keys")))


def _nation():
    return F.regexp_extract("source_file", r"c_nationkey=(\d+)", 1).cast("bigint").alias("nation")


@query("s2_header_rows", """
SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(c_nationkey % 3 AS BIGINT) AS skip_rows FROM customer GROUP BY c_nationkey
""")
def s2_header_rows(spark, d):
    heads = csv_source.find_headers(spark, fixtures.messy_csv(spark, d))
    return heads.select(_nation(), F.col("skip_rows").cast("bigint").alias("skip_rows"))


@query("s3_messy_csv", """
SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS customers, sum(c_custkey) AS keys,
       CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance,
       coalesce(min(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END), '') AS segment
FROM customer GROUP BY 1
""")
def s3_messy_csv(spark, d):
    rows = csv_source.read_messy(spark, fixtures.messy_csv(spark, d), {
        "cust_key": "bigint", "customer_name": "string", "acct_bal_rs": "decimal(12,2)", "col_3": "string"})
    return rows.groupBy(_nation()).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("cust_key").alias("keys"), F.sum("acct_bal_rs").cast("double").alias("balance"),
        F.coalesce(F.min("col_3"), F.lit("")).alias("segment"))


@query("s4_workbooks", """
SELECT concat('cust_', c_custkey, '.xlsx') AS source_file, c_custkey AS cust_key, c_name AS customer_name, c_acctbal AS acct_bal FROM customer
""")
def s4_workbooks(spark, d):
    cells = written(workbook.workbook_cells(fixtures.customer_workbooks(spark, d)), "cells")
    return workbook.tables_from_workbooks(cells, {"cust_key": "bigint", "customer_name": "string", "acct_bal": "double"})


@query("s5_sheet_headers", """
SELECT concat('cust_', c_custkey, '.xlsx') AS source_file, CAST(2 AS BIGINT) AS header_row, 'Cust Key|Customer Name|Acct Bal' AS header FROM customer
""")
def s5_sheet_headers(spark, d):
    heads = workbook.header_rows(workbook.workbook_cells(fixtures.customer_workbooks(spark, d)))
    return heads.select("source_file", F.col("header_row").cast("bigint").alias("header_row"), F.array_join("header", "|").alias("header"))


@query("s8_table_names", f"""
SELECT filename, replace(replace(lower(regexp_replace(filename, '(.)\\.[^.]*$', '\\1')), ' ', '_'), '-', '_') AS table_name
FROM ({st.duck(st.OLD_FILES_SQL)})
""")
def s8_table_names(spark, d):
    return st.from_sql(spark, d, st.OLD_FILES_SQL).select("filename", tx.table_name_of(F.col("filename")).alias("table_name"))


@query("s9_column_names", f"""
SELECT name_id, trim(regexp_replace(lower({strip("raw_name")}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS name FROM ({st.duck(st.RAW_NAMES_SQL)})
""")
def s9_column_names(spark, d):
    return st.from_sql(spark, d, st.RAW_NAMES_SQL).select("name_id", tx.clean_name(F.col("raw_name")).alias("name"))


@query("s10_without_empty", """
SELECT CASE WHEN event_id % 3 > 0 THEN event_id END AS event_id, CASE WHEN event_id % 3 > 0 AND event_type <> 'view' THEN event_type END AS event_type
FROM events WHERE event_id % 3 > 0
""")
def s10_without_empty(spark, d):
    some = F.col("event_id") % 3 > 0
    df = st.table(spark, d, "events").select(
        F.when(some, F.col("event_id")).alias("event_id"), F.lit(None).cast("string").alias("empty"),
        F.when(some & (F.col("event_type") != "view"), F.col("event_type")).alias("event_type"))
    return csv_source.drop_empty(df)


@query("s11_repeated_headers", "SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS name FROM part WHERE p_partkey % 10 <> 3")
def s11_repeated_headers(spark, d):
    header = F.col("p_partkey") % 10 == 3
    df = st.table(spark, d, "part").select(
        F.when(header, F.lit("Part_Key")).otherwise(F.col("p_partkey").cast("string")).alias("part_key"),
        F.when(header, F.when(F.col("p_partkey") % 20 == 3, F.lit("NAME"))).otherwise(F.col("p_name")).alias("name"))
    return csv_source.drop_repeated_headers(df)


_NAMES_SQL = """
SELECT concat('t', CAST(l_orderkey AS STRING)) AS table_name, l_linenumber, l_partkey,
       CASE l_orderkey % 5 WHEN 0 THEN concat('col_', CAST(l_linenumber AS STRING)) WHEN 1 THEN concat('20', CAST(l_partkey AS STRING))
            WHEN 2 THEN concat(repeat('long name ', 6), CAST(l_linenumber AS STRING)) WHEN 3 THEN concat('unnamed_', CAST(l_linenumber AS STRING), 'x')
            ELSE concat('field_', CAST(l_linenumber AS STRING)) END AS column_name
FROM {lineitem}
"""
_FIRST_ROW_SQL = "SELECT concat('t', CAST(o_orderkey AS STRING)) AS table_name, o_orderstatus, o_orderpriority, o_orderkey FROM {orders}"


@query("s12_header_issues", f"""
WITH c AS ({st.duck(_NAMES_SQL)}),
s AS (SELECT table_name, count(*) AS n, count(*) FILTER (WHERE starts_with(column_name, 'unnamed') OR starts_with(column_name, 'col_') OR starts_with(column_name, 'column')) AS g,
             count(*) FILTER (WHERE regexp_matches(regexp_replace(column_name, '[_.]', '', 'g'), '^[0-9]+$')) AS d,
             count(*) FILTER (WHERE length(column_name) > 50) AS l FROM c GROUP BY 1),
i AS (SELECT s.table_name, list_filter([
   CASE WHEN g > n * 0.3 THEN concat(g, ' columns have generic names (unnamed/col_)') END,
   CASE WHEN d > 0 THEN concat(d, ' column names are numeric (may be data, not headers)') END,
   CASE WHEN l > 0 THEN concat(l, ' column names are very long (>50 chars)') END,
   CASE WHEN o.o_orderkey % 7 = 1 THEN 'First data row looks like it might be headers' END], lambda x: x IS NOT NULL) AS issues
 FROM s LEFT JOIN orders o ON s.table_name = concat('t', o.o_orderkey))
SELECT table_name, len(issues) = 0 AS valid, array_to_string(issues, '; ') AS issues FROM i
""")
def s12_header_issues(spark, d):
    first = st.from_sql(spark, d, _FIRST_ROW_SQL).select("table_name", F.array(
        F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("Amount"),
        F.when(F.col("o_orderkey") % 7 == 1, F.lit("Bill No")).otherwise(F.col("o_orderkey").cast("string"))).alias("values"))
    issues = csv_source.header_issues(st.from_sql(spark, d, _NAMES_SQL), first)
    return issues.withColumn("issues", F.array_join("issues", "; "))


@query("s13_saved_table", _BY_STATUS)
def s13_saved_table(spark, d):
    df = st.table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    stores.drop_table(spark, "khata_orders")
    stores.save_table(df, "khata_orders", shared_dir(spark, "saved-orders"))
    stores.register_view(spark.table("khata_orders"), "khata_saved_orders")
    return _by_status(spark.table("khata_saved_orders"))


@query("s14_file_manifest", """
SELECT concat('c_nationkey=', c_nationkey) AS folder, md5(concat(string_agg(concat(c_custkey, ',', c_name), chr(10) ORDER BY c_custkey), chr(10))) AS file_hash,
       CAST(sum(strlen(concat(c_custkey, ',', c_name)) + 1) AS BIGINT) AS file_size
FROM customer GROUP BY c_nationkey
""")
def s14_file_manifest(spark, d):
    """Digests of real files of all customers, a file per nation, as a folder scan finds them."""
    found = manifest.scan_files(spark, fixtures.customer_files(spark, d), recursive=True, globs=("*.txt",))
    return found.select(F.element_at(F.split("file_path", "/"), -2).alias("folder"), "file_hash", "file_size")


@query("s24_tenant_profiles", """
SELECT concat('tenant_', s_suppkey) AS customer_id, CASE WHEN s_suppkey % 5 = 0 THEN concat('tenant_', s_suppkey) ELSE s_name END AS company_name, CAST(s_nationkey AS VARCHAR) AS state_code
FROM supplier WHERE s_suppkey % 7 <> 3
""")
def s24_tenant_profiles(spark, d):
    """Profiles of all tenants of a workspace by company; broken ones are left out."""
    return stores.read_profiles(spark, fixtures.tenant_folders(spark, d)).select("customer_id", "company_name", "state_code")


_CHANGES = f"""
WITH o AS ({st.duck(st.OLD_FILES_SQL)}), n AS ({st.duck(st.NEW_FILES_SQL)}), loaded AS ({st.duck(st.LOADED_TABLES_SQL)}),
changes AS (
  SELECT coalesce(o.filename, n.filename) AS filename, o.table_name, o.file_hash AS old_hash, n.file_hash AS new_hash,
         CASE WHEN o.filename IS NULL THEN 'NEW' WHEN n.filename IS NULL THEN 'DELETED' WHEN o.file_hash <> n.file_hash THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change
  FROM o FULL JOIN n ON o.filename = n.filename)
"""


def _changes(spark, d):
    return manifest.detect_changes(st.from_sql(spark, d, st.OLD_FILES_SQL), st.from_sql(spark, d, st.NEW_FILES_SQL))


def _loaded(spark, d):
    return st.from_sql(spark, d, st.LOADED_TABLES_SQL)


@query("s15_file_changes", _CHANGES + """
SELECT *, CASE change WHEN 'NEW' THEN 'New file detected' WHEN 'DELETED' THEN 'File no longer exists' WHEN 'MODIFIED' THEN 'File contents changed'
          ELSE 'No changes' END AS reason FROM changes
""")
def s15_file_changes(spark, d):
    return _changes(spark, d)


@query("j11_manifest_join", _CHANGES + "SELECT change, count(*) AS files FROM changes GROUP BY 1")
def j11_manifest_join(spark, d):
    return _changes(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


@query("s16_load_plan", _CHANGES + """
SELECT filename, change FROM changes WHERE change IN ('NEW', 'MODIFIED')
UNION ALL SELECT filename, 'NEW' FROM changes WHERE change = 'UNCHANGED' AND table_name IS NOT NULL AND table_name NOT IN (SELECT table_name FROM loaded)
""")
def s16_load_plan(spark, d):
    return manifest.load_plan(_changes(spark, d), _loaded(spark, d))


@query("j12_lost_tables", _CHANGES + """
SELECT table_name FROM o WHERE table_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM loaded l WHERE l.table_name = o.table_name)
""")
def j12_lost_tables(spark, d):
    state = manifest.loaded_tables(st.from_sql(spark, d, st.OLD_FILES_SQL))
    return manifest.lost_tables(state, _loaded(spark, d)).select("table_name")


@query("s17_tables_to_drop", _CHANGES + "SELECT table_name FROM changes WHERE change = 'DELETED' AND table_name IS NOT NULL")
def s17_tables_to_drop(spark, d):
    return manifest.tables_to_drop(_changes(spark, d))


@query("s18_change_summary", _CHANGES + """
SELECT count(*) FILTER (WHERE change <> 'DELETED') AS total_files, count(*) FILTER (WHERE change <> 'NEW') AS loaded_files,
       count(*) FILTER (WHERE change = 'NEW') AS new_files, count(*) FILTER (WHERE change = 'MODIFIED') AS modified_files,
       count(*) FILTER (WHERE change = 'DELETED') AS deleted_files,
       bool_or(change <> 'UNCHANGED' OR (table_name IS NOT NULL AND table_name NOT IN (SELECT table_name FROM loaded))) AS needs_reload FROM changes
""")
def s18_change_summary(spark, d):
    return manifest.summary(_changes(spark, d), _loaded(spark, d))


@query("s18_loaded_map", _CHANGES + "SELECT filename, table_name FROM o WHERE table_name IS NOT NULL AND filename NOT IN (SELECT filename FROM changes WHERE change = 'DELETED')")
def s18_loaded_map(spark, d):
    old = st.from_sql(spark, d, st.OLD_FILES_SQL)
    gone = _changes(spark, d).where(F.col("change") == "DELETED")
    return manifest.loaded_tables(manifest.forget(old, gone))


@query("u3_file_sets", _CHANGES + """
SELECT 'new' AS part, filename FROM n WHERE filename NOT IN (SELECT filename FROM o)
UNION ALL SELECT 'gone', filename FROM o WHERE filename NOT IN (SELECT filename FROM n)
UNION ALL SELECT 'both', filename FROM o WHERE filename IN (SELECT filename FROM n)
""")
def u3_file_sets(spark, d):
    o, n = (st.from_sql(spark, d, q).select("filename") for q in (st.OLD_FILES_SQL, st.NEW_FILES_SQL))
    parts = [("new", n.subtract(o)), ("gone", o.subtract(n)), ("both", o.intersect(n))]
    out = [p.select(F.lit(name).alias("part"), "filename") for name, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s19_manifest_store", _CHANGES + "SELECT filename, file_hash, file_size, table_name FROM o")
def s19_manifest_store(spark, d):
    path = shared_dir(spark, "manifest")
    files = st.from_sql(spark, d, st.OLD_FILES_SQL)
    manifest.write_manifest(files.where(F.col("file_size") % 2 == 0), path)
    rest = files.where(F.col("file_size") % 2 != 0)
    # overwritten in place with what was read from it
    manifest.write_manifest(manifest.read_manifest(spark, path).unionByName(rest, allowMissingColumns=True), path)
    return manifest.read_manifest(spark, path).select("filename", "file_hash", "file_size", "table_name")


@query("s21_catalog_store", f"""
WITH cat AS ({st.CATALOG_DUCK})
SELECT table_name, CASE WHEN starts_with(table_name, 'sales') THEN 'fresh' ELSE 'old' END AS description FROM cat WHERE NOT starts_with(table_name, 'bank')
UNION ALL SELECT concat(table_name, '_new'), 'fresh' FROM cat WHERE starts_with(table_name, 'bank')
""")
def s21_catalog_store(spark, d):
    names = st.from_sql(spark, d, st.CATALOG_SQL)
    bank, sales = F.col("table_name").startswith("bank"), F.col("table_name").startswith("sales")
    path = shared_dir(spark, "catalog")
    stores.write_catalog(names.where(~bank).withColumn("description", F.lit("old")), path)
    fresh = names.where(bank | sales).select(
        F.when(bank, F.concat("table_name", F.lit("_new"))).otherwise(F.col("table_name")).alias("table_name"),
        F.lit("fresh").alias("description"))
    stores.write_catalog(stores.upsert(stores.read_catalog(spark, path), fresh), path)
    return stores.read_catalog(spark, path).select("table_name", "description")


@query("s22_metrics_store", f"WITH log AS ({st.duck(st.METRICS_SQL)}) SELECT name, type, count(*) AS records, max(value) AS max_value FROM log GROUP BY 1, 2")
def s22_metrics_store(spark, d):
    path = shared_dir(spark, "metrics")
    log = st.from_sql(spark, d, st.METRICS_SQL).select(
        "name", "type", "value", F.col("ts").cast("timestamp").alias("timestamp"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"))
    stores.append_metrics(log, path)
    return stores.read_metrics(spark, path).groupBy("name", "type").agg(
        F.count(F.lit(1)).alias("records"), F.max("value").alias("max_value"))


@query("s25_accepted_files", f"""
SELECT filename, ext IN ('.xlsx', '.xls', '.csv') AND file_size <= 52428800 AS accepted,
  CASE WHEN ext NOT IN ('.xlsx', '.xls', '.csv') THEN concat('Invalid file type: ', ext, '. Allowed: .csv, .xls, .xlsx')
       WHEN file_size > 52428800 THEN printf('File too large: %.1fMB. Max: 50MB', file_size::DOUBLE / 1024.0::DOUBLE / 1024.0::DOUBLE) ELSE '' END AS refusal
FROM (SELECT *, lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)) AS ext FROM (
  SELECT CASE WHEN file_size % 4 = 0 AND file_size % 3 = 1 THEN concat(filename, '.PDF') ELSE filename END AS filename, file_size FROM ({st.duck(st.NEW_FILES_SQL)})))
""")
def s25_accepted_files(spark, d):
    files = st.from_sql(spark, d, st.NEW_FILES_SQL)
    odd = (F.col("file_size") % 4 == 0) & (F.col("file_size") % 3 == 1)
    files = files.withColumn("filename", F.when(odd, F.concat("filename", F.lit(".PDF"))).otherwise(F.col("filename")))
    name, size = F.col("filename"), F.col("file_size")
    return files.select("filename", csv_source.is_accepted(name, size).alias("accepted"), csv_source.refusal(name, size).alias("refusal"))


@query("s26_file_listing", f"""
WITH n AS ({st.duck(st.NEW_FILES_SQL)}), loaded AS ({st.duck(st.LOADED_TABLES_SQL)}),
t AS (SELECT *, replace(replace(lower(regexp_replace(filename, '(.)\\.[^.]*$', '\\1')), ' ', '_'), '-', '_') AS t FROM n)
SELECT t.filename AS name, round(file_size / 1024.0::DOUBLE, 2) AS size_kb, l.table_name, CASE WHEN l.table_name IS NOT NULL THEN CAST(length(l.table_name) AS BIGINT) END AS row_count
FROM t LEFT JOIN loaded l ON l.table_name = t.t
""")
def s26_file_listing(spark, d):
    files = st.from_sql(spark, d, st.NEW_FILES_SQL).withColumn("modified_time", F.lit(None).cast("timestamp"))
    catalog = _loaded(spark, d).withColumn("row_count", F.length("table_name").cast("bigint"))
    return manifest.listing(files, catalog).drop("modified")


@query("s29_removed_file", f"""
WITH o AS ({st.duck(st.OLD_FILES_SQL)}), loaded AS ({st.duck(st.LOADED_TABLES_SQL)})
SELECT 'manifest' AS store, count(*) AS entries FROM o WHERE filename <> 'Purchase Ledger-8.csv'
UNION ALL SELECT 'catalog', count(*) FROM loaded WHERE table_name <> 'purchase_ledger_8'
""")
def s29_removed_file(spark, d):
    left, tables = manifest.remove_file(st.from_sql(spark, d, st.OLD_FILES_SQL), _loaded(spark, d), "Purchase Ledger-8.csv")
    count = F.count(F.lit(1)).alias("entries")
    return (left.agg(count).withColumn("store", F.lit("manifest"))
            .unionByName(tables.agg(count).withColumn("store", F.lit("catalog"))))


@query("s20_incremental_load", """
SELECT concat('ledger_', c_custkey // 100) AS source_table, count(*) AS customers, sum(c_custkey) AS keys,
       CAST(sum(CAST(c_acctbal AS DECIMAL(12,2)) + CASE WHEN (c_custkey // 100) % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS balance
FROM customer WHERE (c_custkey // 100) % 5 <> 1 GROUP BY 1
UNION ALL SELECT concat('cust_', c_custkey), 1, c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE)
FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 150 <> 0
""")
def s20_incremental_load(spark, d):
    dataset, first, second = (shared_dir(spark, n) for n in ("dataset", "manifest", "manifest"))
    manifest.load_files(fixtures.mixed_files(spark, d, 1), dataset, shared_dir(spark, "none"), first)
    manifest.load_files(fixtures.mixed_files(spark, d, 2), dataset, first, second)
    rows = manifest.open_dataset(spark, dataset, manifest.read_manifest(spark, second))
    return rows.groupBy("source_table").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.col("cust_key").cast("bigint")).alias("keys"),
        F.sum(F.col("acct_bal").cast("decimal(12,2)")).cast("double").alias("balance"))


@query("s6_readers_by_extension", "SELECT 'csv' AS kind, count(*) AS n, sum(o_orderkey) AS keys FROM orders")
def s6_readers_by_extension(spark, d):
    path = shared_dir(spark, "one-csv") + "/orders.csv"
    st.table(spark, d, "orders").select("o_orderkey", "o_custkey").write.option("header", True).csv(path)
    rows = csv_source.read_by_extension(spark, path, columns={"o_orderkey": "bigint"})
    return rows.agg(F.lit("csv").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s14_content_hashes", """
SELECT concat('c', c_custkey, '.csv') AS filename, md5(concat('Name', chr(10), c_name)) AS file_hash,
       CAST(strlen(c_name) + 5 AS BIGINT) AS file_size FROM customer
""")
def s14_content_hashes(spark, d):
    content = F.concat_ws("\n", F.lit("Name"), F.col("c_name")).cast("binary")
    files = st.table(spark, d, "customer").select(
        F.format_string("/in/c%d.csv", F.col("c_custkey")).alias("path"), content.alias("content"),
        F.octet_length(content).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return manifest.describe(files).select("filename", "file_hash", "file_size")
