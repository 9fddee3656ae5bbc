"""Query shapes over ledger tables: filters, projections, totals, trends, documented extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.operators import family, metrics, names, roles, screening
from khata.plans import standins as st
from khata.plans.registry import query
from khata.session import spread

ORDERS_SQL = ("SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total "
              "FROM {orders} GROUP BY o_orderstatus")
CTE_SQL = ("WITH big AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(14,2)) AS price FROM {orders}) "
           "SELECT o_custkey, CAST(sum(price) AS DOUBLE) AS total FROM big GROUP BY o_custkey ORDER BY total DESC, o_custkey")


@query("q1_guarded_select", st.duck(ORDERS_SQL))
def q1_guarded_select(spark, d):
    return screening.guarded_sql(spark, ORDERS_SQL, {"orders": st.table(spark, d, "orders")})


@query("q9_guarded_cte", st.duck(CTE_SQL))
def q9_guarded_cte(spark, d):
    return screening.guarded_sql(spark, CTE_SQL, {"orders": st.table(spark, d, "orders")})


@query("t4_row_cap", st.duck(CTE_SQL) + " LIMIT 20")
def t4_row_cap(spark, d):
    return screening.guarded_sql(spark, CTE_SQL, {"orders": st.table(spark, d, "orders")}, row_cap=fv.SQL_ROW_CAP)


_DESCRIBED = [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"),
              ("o_orderdate", "date"), ("o_orderpriority", "text")]


@query("q2_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS filled FROM orders" for c, k in _DESCRIBED))
def q2_describe(spark, d):
    from khata.operators.catalog import kind_of
    df = st.table(spark, d, "orders")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return wide.unpivot([], df.columns, "column_name", "filled").withColumn("kind", named[F.col("column_name")])


@query("q3_sample_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")
def q3_sample_rows(spark, d):
    return st.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(10)


@query("q4_text_contains", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%gear%' ORDER BY p_partkey LIMIT 20")
def q4_text_contains(spark, d):
    return (st.table(spark, d, "part").where(F.col("p_name").like("%gear%")).select("p_partkey", "p_name")
            .orderBy("p_partkey").limit(fv.SQL_ROW_CAP))


@query("q5_month_filter", """
SELECT 'text' AS kind, count(*) AS orders FROM orders WHERE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) LIKE '1997-03%'
UNION ALL SELECT 'date', count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-03'
""")
def q5_month_filter(spark, d):
    orders = st.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    as_text = orders.where(F.col("day").cast("string").startswith("1997-03")).select(F.lit("text").alias("kind"))
    as_date = orders.where(F.date_format("day", "yyyy-MM") == "1997-03").select(F.lit("date").alias("kind"))
    return as_text.unionByName(as_date).groupBy("kind").agg(F.count(F.lit(1)).alias("orders"))


@query("q6_null_tests", st.WITH_LEDGER + """
SELECT count(*) FILTER (WHERE payment_date IS NULL) AS unpaid, count(*) FILTER (WHERE payment_date IS NOT NULL) AS paid FROM purchase_ledger
""")
def q6_null_tests(spark, d):
    p = F.col("payment_date")
    return st.purchase_ledger(spark, d, "payment_date").agg(
        F.count_if(p.isNull()).alias("unpaid"), F.count_if(p.isNotNull()).alias("paid"))


@query("q7_computed_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS "Gross Value",
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.18 AS DOUBLE) AS tax_at_18 FROM lineitem
""")
def q7_computed_columns(spark, d):
    return st.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "CAST(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS `Gross Value`",
        "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.18 AS DOUBLE) AS tax_at_18")


@query("q8_column_roles", """
SELECT event_id, CAST(coalesce(nullif(cgst_rate, 0) * 2, nullif(tax_rate, 0), nullif(gst_rate, 0)) AS DOUBLE) AS rate,
       coalesce(nullif(vendor, ''), party_name) AS vendor
FROM (SELECT event_id, CAST(user_id % 3 AS DECIMAL(6,2)) AS cgst_rate, CASE WHEN user_id % 4 = 0 THEN 5 END AS tax_rate,
             CAST(user_id % 2 * 18 AS DECIMAL(6,2)) AS gst_rate, CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END AS vendor,
             concat('user ', user_id) AS party_name FROM events)
""")
def q8_column_roles(spark, d):
    t = st.table(spark, d, "events").selectExpr(
        "event_id", "CAST(user_id % 3 AS DECIMAL(6,2)) AS cgst_rate", "CASE WHEN user_id % 4 = 0 THEN 5 END AS tax_rate",
        "CAST(user_id % 2 * 18 AS DECIMAL(6,2)) AS gst_rate", "CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END AS vendor",
        "concat('user ', user_id) AS party_name")
    return t.select("event_id", roles.role_number(t.columns, "rate").cast("double").alias("rate"),
                    roles.role_text(t.columns, "vendor").alias("vendor"))


@query("q10_as_of_date", f"""
SELECT CAST(o_orderdate AS DATE) > DATE '{st.AS_OF}' AS in_future, count(*) AS orders FROM orders GROUP BY 1
""")
def q10_as_of_date(spark, d):
    future = (F.col("o_orderdate").cast("date") > st.as_of()).alias("in_future")
    return st.table(spark, d, "orders").groupBy(future).agg(F.count(F.lit(1)).alias("orders"))


# --- aggregates ----------------------------------------------------------------------

@query("a1_row_counts", st.WITH_LEDGER + """
SELECT coalesce(source_table, 'all tables') AS source_table, count(*) AS rows FROM purchase_ledger GROUP BY ROLLUP (source_table)
""")
def a1_row_counts(spark, d):
    return (st.purchase_ledger(spark, d, "source_table").rollup("source_table").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("source_table", F.coalesce("source_table", F.lit("all tables"))))


@query("a2_date_range", st.WITH_LEDGER + """
SELECT source_table, min(invoice_date) AS min_date, max(invoice_date) AS max_date FROM purchase_ledger
WHERE invoice_date IS NOT NULL GROUP BY 1
""")
def a2_date_range(spark, d):
    from khata.operators.catalog import date_column
    df = st.purchase_ledger(spark, d, "source_table", "vendor_id", "invoice_date")
    day = date_column(df)
    return df.where(F.col(day).isNotNull()).groupBy("source_table").agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


@query("a3_null_counts", st.WITH_LEDGER + """
SELECT * FROM (
  SELECT source_table, 'payment_date' AS column_name, count(*) FILTER (WHERE payment_date IS NULL) AS nulls FROM purchase_ledger GROUP BY 1
  UNION ALL SELECT source_table, 'bill_no', count(*) FILTER (WHERE bill_no IS NULL) FROM purchase_ledger GROUP BY 1
  UNION ALL SELECT source_table, 'vendor_id', count(*) FILTER (WHERE vendor_id IS NULL) FROM purchase_ledger GROUP BY 1)
WHERE nulls > 0
""")
def a3_null_counts(spark, d):
    from khata.operators.catalog import null_counts
    df = st.purchase_ledger(spark, d, "source_table", "bill_no", "payment_date", "vendor_id")
    return null_counts(df, ["bill_no", "payment_date", "vendor_id"])


@query("a4_distinct_counts", st.WITH_LEDGER + """
SELECT source_table, count(DISTINCT vendor) AS vendors, count(DISTINCT item) AS items FROM purchase_ledger GROUP BY 1
""")
def a4_distinct_counts(spark, d):
    return st.purchase_ledger(spark, d, "source_table", "vendor", "item").groupBy("source_table").agg(
        F.count_distinct("vendor").alias("vendors"), F.count_distinct("item").alias("items"))


@query("a5_numeric_sums", st.WITH_LEDGER + """
SELECT source_table, CAST(sum(taxable_value) AS DOUBLE) AS taxable_value, CAST(sum(total_value) AS DOUBLE) AS total_value
FROM purchase_ledger GROUP BY 1
""")
def a5_numeric_sums(spark, d):
    df = st.purchase_ledger(spark, d, "source_table", "taxable_value", "total_value")
    return df.groupBy("source_table").agg(*[F.sum(c).cast("double").alias(c) for c in ("taxable_value", "total_value")])


@query("a6_sum_by_group", st.WITH_LEDGER + """
SELECT hsn_code, CAST(sum(total_value) AS DOUBLE) AS total FROM purchase_ledger GROUP BY 1 ORDER BY 2 DESC
""")
def a6_sum_by_group(spark, d):
    sums = st.purchase_ledger(spark, d, "hsn_code", "total_value").groupBy("hsn_code").agg(F.sum("total_value").cast("double").alias("total"))
    return sums.orderBy(F.desc("total"))


@query("a7_family_total", st.WITH_LEDGER + "SELECT CAST(sum(total_value) AS DOUBLE) AS total_amount FROM purchase_ledger")
def a7_family_total(spark, d):
    return family.total(st.purchase_ledger(spark, d, "total_value"), "total_value")


@query("a8_family_top", st.WITH_LEDGER + """
SELECT vendor, CAST(sum(total_value) AS DOUBLE) AS total_amount FROM purchase_ledger GROUP BY vendor ORDER BY sum(total_value) DESC, vendor LIMIT 5
""")
def a8_family_top(spark, d):
    return family.top_by_total(st.purchase_ledger(spark, d, "vendor", "total_value"), "vendor", "total_value")


@query("a9_monthly_trend", st.WITH_LEDGER + """
SELECT year(m) AS year, month(m) AS month_no, strftime(m, '%B') AS month, total
FROM (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS m, CAST(sum(total_value) AS DOUBLE) AS total FROM purchase_ledger GROUP BY 1)
""")
def a9_monthly_trend(spark, d):
    return family.monthly_trend(st.purchase_ledger(spark, d, "invoice_date", "total_value"), "invoice_date", "total_value")


@query("a10_example_shapes", """
SELECT 'count by o_orderstatus' AS shape, o_orderstatus AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2
UNION ALL SELECT 'sum by o_orderpriority', o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) FROM orders GROUP BY 2
UNION ALL SELECT 'total', '', CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) FROM orders
UNION ALL SELECT 'trend', strftime(o_orderdate, '%Y-%m'), CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) FROM orders GROUP BY 2
""")
def a10_example_shapes(spark, d):
    orders = st.table(spark, d, "orders").select(
        "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    # the four shapes are grouping sets of one scan
    sets = orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], [], ["month"]], "o_orderstatus", "o_orderpriority", "month").agg(
        F.grouping_id("o_orderstatus", "o_orderpriority", "month").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"))
    shape = F.when(F.col("g") == 3, "count by o_orderstatus").when(F.col("g") == 5, "sum by o_orderpriority").when(
        F.col("g") == 6, "trend").otherwise("total")
    return sets.select(shape.alias("shape"), F.coalesce("o_orderstatus", "o_orderpriority", "month", F.lit("")).alias("label"),
                       F.when(F.col("g") == 3, F.col("n").cast("double")).otherwise(F.col("s").cast("double")).alias("value"))


@query("u1_family_union", """
SELECT concat('orders_', lower(o_orderstatus)) AS source_table, count(*) AS rows, count(priority) AS with_priority,
       CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS priority FROM orders) WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1
""")
def u1_family_union(spark, d):
    orders = st.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority")
    parts = {f"orders_{s.lower()}": orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    parts["orders_f"] = parts["orders_f"].drop("priority")
    return family.union_family(parts).groupBy("source_table").agg(
        F.count(F.lit(1)).alias("rows"), F.count("priority").alias("with_priority"),
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"))


# --- metrics -------------------------------------------------------------------------

_LOG = f"WITH log AS ({st.duck(st.METRICS_SQL)})\n"


def log(spark, d):
    return st.from_sql(spark, d, st.METRICS_SQL)


@query("a16_latency_overall", _LOG + """
SELECT count(*) AS count, coalesce(round(avg(value), 6), 0) AS avg_ms, coalesce(max(value), 0) AS max_ms, coalesce(min(value), 0) AS min_ms
FROM log WHERE type = 'latency'
""")
def a16_latency_overall(spark, d):
    return metrics.latency_overall(log(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("a17_latency_by_operation", _LOG + """
SELECT replace(name, 'latency.', '') AS op, count(*) AS count, round(avg(value), 6) AS avg_ms, max(value) AS max_ms, min(value) AS min_ms,
       CASE WHEN count(*) >= 20 THEN list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] ELSE max(value) END AS p95_ms
FROM log WHERE type = 'latency' GROUP BY 1
""")
def a17_latency_by_operation(spark, d):
    return metrics.latency_by_operation(log(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("a18_compliance_by_type", _LOG + """
SELECT replace(name, 'compliance.', '') AS issue_type, count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_amount
FROM log WHERE type = 'compliance' GROUP BY 1
""")
def a18_compliance_by_type(spark, d):
    return metrics.compliance_by_type(log(spark, d))


@query("a19_usage", _LOG + """
SELECT count(*) FILTER (WHERE starts_with(name, 'query.')) AS queries_total, count(*) FILTER (WHERE starts_with(name, 'error.')) AS errors_total,
       count(*) FILTER (WHERE name = 'data.file_processed') AS files_processed, count(*) FILTER (WHERE starts_with(name, 'compliance.')) AS compliance_issues_found,
       CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE name = 'compliance.tax_savings'), 0) AS DOUBLE) AS total_tax_savings,
       CAST(date_sub('second', min(ts), max(ts)) AS BIGINT) AS session_seconds, count(*) AS metrics_count
FROM log
""")
def a19_usage(spark, d):
    return metrics.usage(log(spark, d))


@query("x5_daily_monitor", _LOG + """
, ranked AS (SELECT CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value) AS r,
                    count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM log WHERE type = 'latency'),
p AS (SELECT day, value AS p99_ms FROM ranked WHERE r = CAST(ceil(n * 0.99::DOUBLE) AS BIGINT)),
c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE type = 'error') AS errors FROM log GROUP BY 1)
SELECT day, calls, users, errors, p99_ms, errors::DOUBLE / calls::DOUBLE AS error_rate,
       CASE WHEN errors::DOUBLE / calls::DOUBLE > 0.1 THEN 'page' WHEN p99_ms > 15000 THEN 'warning' ELSE 'ok' END AS alert
FROM c LEFT JOIN p USING (day)
""")
def x5_daily_monitor(spark, d):
    return metrics.daily_monitor(log(spark, d))


# --- documented extras ---------------------------------------------------------------

@query("x1_ledger_checks", st.WITH_LEDGER + """
SELECT source_table, count(*) AS rows, count(*) FILTER (WHERE abs(total_value - taxable_value - cgst_amount - sgst_amount - igst_amount) > 1) AS total_mismatch,
       count(*) FILTER (WHERE total_value = 0) AS zero_amount, count(*) FILTER (WHERE total_value < 0) AS negative_amount,
       count(*) FILTER (WHERE NOT regexp_matches(vendor_gstin, '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$')
                        OR NOT (CAST(substr(vendor_gstin, 1, 2) AS INT) BETWEEN 1 AND 37 OR CAST(substr(vendor_gstin, 1, 2) AS INT) IN (97, 99))) AS bad_gstin,
       count(*) FILTER (WHERE year(invoice_date) NOT BETWEEN 1996 AND 2000) AS odd_year
FROM purchase_ledger GROUP BY 1
""")
def x1_ledger_checks(spark, d):
    from khata.operators.ledger_checks import ledger_checks
    df = st.purchase_ledger(spark, d, "source_table", "invoice_date", "vendor_gstin", "taxable_value", "cgst_amount",
                            "sgst_amount", "igst_amount", "total_value").withColumnRenamed("vendor_gstin", "gstin")
    return ledger_checks(df, years=(1996, 2000))


@query("x2_duplicates", st.WITH_LEDGER + """
SELECT bill_no, vendor_id, count(*) AS copies FROM purchase_ledger GROUP BY 1, 2 HAVING count(*) > 1
""")
def x2_duplicates(spark, d):
    return family.duplicates(st.purchase_ledger(spark, d, "bill_no", "vendor_id"), ["bill_no", "vendor_id"])


SPELLED_SQL = """
SELECT CASE l_orderkey % 40 WHEN 1 THEN replace(s_name, 'Supplier', 'Suplier') WHEN 2 THEN replace(s_name, 'Supplier', 'Supplyer')
       WHEN 3 THEN replace(s_name, 'Supplier', 'Suppllier') ELSE s_name END AS vendor
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""


def _spelling_sql(edits):
    return f"""
WITH n AS (SELECT vendor AS name, count(*) AS uses FROM ({st.duck(SPELLED_SQL)}) GROUP BY 1)
SELECT a.name, a.uses, arg_max(b.name, (b.uses, b.name)) AS likely, arg_max(b.uses, (b.uses, b.name)) AS likely_uses
FROM n a JOIN n b ON a.name <> b.name AND levenshtein(a.name, b.name) <= {edits} AND (b.uses, b.name) > (a.uses, a.name)
GROUP BY 1, 2
"""


@query("x3_name_spelling", _spelling_sql(1))
def x3_name_spelling(spark, d):
    return names.likely_spelling(st.from_sql(spark, d, SPELLED_SQL), "vendor")


@query("x3_name_spelling_two_edits", _spelling_sql(2))
def x3_name_spelling_two_edits(spark, d):
    return names.likely_spelling(st.from_sql(spark, d, SPELLED_SQL), "vendor", edits=2)


_RUNS = f"""
WITH s AS (SELECT upper(trim(sql_text, concat(' ', chr(10)))) AS s FROM ({st.duck(st.SQL_TEXTS_SQL)})),
r AS (SELECT CASE WHEN s = '' THEN 'empty' WHEN length(s) > 10000 THEN 'too long' WHEN NOT (starts_with(s, 'SELECT') OR starts_with(s, 'WITH')) THEN 'not a query'
                  ELSE 'query' END AS outcome FROM s)
"""


@query("x4_sql_success", _RUNS + """
SELECT outcome, count(*) AS runs, CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM r) AS share FROM r GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5
""")
def x4_sql_success(spark, d):
    from khata.operators.ledger_checks import outcome_shares
    issues = F.col("issues")
    outcome = (F.when(F.array_contains(issues, "Empty SQL query"), "empty")
               .when(F.exists(issues, lambda i: i.startswith("Query too long")), "too long")
               .when(F.array_contains(issues, "Query must start with SELECT or WITH"), "not a query").otherwise("query"))
    runs = screening.screen_sql(spread(st.from_sql(spark, d, st.SQL_TEXTS_SQL)), "sql_text").select(outcome.alias("outcome"))
    return outcome_shares(runs, "outcome")


# --- scalar functions ----------------------------------------------------------------

@query("f_scalar_functions", """
SELECT c_custkey, lower(c_name) AS f1, replace(upper(trim(concat('  ', c_mktsegment, ' '))), 'I', '') AS f2, left(c_name, 9) AS f3, length(c_name) AS f4,
       starts_with(c_mktsegment, 'B') OR contains(c_name, '77') AS f5, array_to_string(string_split(c_name, '#'), '|') AS f6,
       regexp_extract(c_name, '([1-9][0-9]*)$', 1) AS f7, regexp_matches(CAST(c_custkey AS VARCHAR), '^[0-9]+$') AS f8, md5(c_name) AS f10,
       sha256(c_name) AS f10b, try_cast(concat(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END, c_custkey) AS DOUBLE) AS f11,
       CAST(try_strptime(concat('1998-', 1 + c_custkey % 14, '-28'), '%Y-%m-%d') AS DATE) AS f12,
       date_diff('day', DATE '1998-01-31', DATE '1998-01-31' + CAST(c_custkey % 400 AS INT)) AS f13,
       make_date(1998 + c_custkey % 3, 1 + c_custkey % 12, 28) AS f14, strftime(make_date(1998, 1 + c_custkey % 12, 1), '%B %Y %b') AS f15,
       CAST(greatest(abs(CAST(c_acctbal AS DECIMAL(12,2))), 100) AS DOUBLE) AS f16, format('{:,}', c_custkey * 1234567) AS f17,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS f18, to_json(c_name) AS f19, array_to_string(([c_custkey, 2, 3])[1:2], ',') AS f20
FROM customer
""")
def f_scalar_functions(spark, d):
    name, seg, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    small = (key % 12).cast("int")
    start = F.lit("1998-01-31").cast("date")
    return st.table(spark, d, "customer").select(
        "c_custkey", F.lower(name).alias("f1"), F.translate(F.upper(F.trim(F.concat(F.lit("  "), seg, F.lit(" ")))), "I", "").alias("f2"),
        F.left(name, F.lit(9)).alias("f3"), F.length(name).cast("bigint").alias("f4"), (seg.startswith("B") | name.contains("77")).alias("f5"),
        F.array_join(F.split(name, "#"), "|").alias("f6"), F.regexp_extract(name, "([1-9][0-9]*)$", 1).alias("f7"),
        key.cast("string").rlike("^[0-9]+$").alias("f8"), F.md5(name).alias("f10"), F.sha2(name, 256).alias("f10b"),
        F.concat(F.when(key % 3 == 0, F.lit("x")).otherwise(""), key).try_cast("double").alias("f11"),
        F.try_to_date(F.concat(F.lit("1998-"), key % 14 + 1, F.lit("-28")), "yyyy-M-d").alias("f12"),
        F.datediff(F.date_add(start, (key % 400).cast("int")), start).cast("bigint").alias("f13"),
        F.make_date((key % 3 + 1998).cast("int"), small + 1, F.lit(28)).alias("f14"),
        F.date_format(F.make_date(F.lit(1998), small + 1, F.lit(1)), "MMMM yyyy MMM").alias("f15"),
        F.greatest(F.abs(F.col("c_acctbal").cast("decimal(12,2)")), F.lit(100)).cast("double").alias("f16"),
        F.format_number(key * 1234567, 0).alias("f17"), F.coalesce(F.nullif(seg, F.lit("BUILDING")), F.lit("none")).alias("f18"),
        F.regexp_extract(F.to_json(F.struct(name.alias("v"))), r'^\{"v":(.*)\}$', 1).alias("f19"),
        F.array_join(F.slice(F.array(key, F.lit(2), F.lit(3)), 1, 2).cast("array<string>"), ",").alias("f20"))
