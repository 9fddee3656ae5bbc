"""Catalog, profiling and table choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.operators import catalog, roles
from khata.plans import standins as st
from khata.plans.duck import any_contains, lit
from khata.plans.registry import query
from khata.session import spread

# --- inputs --------------------------------------------------------------------------

FILE_DUCK = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('Purchase ', strftime(o_orderdate, '%B %Y'), '.xlsx')
  WHEN 1 THEN concat('sales-', strftime(o_orderdate, '%Y'), '.csv') WHEN 2 THEN concat('Bank_Statement_', o_custkey, '.v2.csv')
  ELSE concat('MARCH market-200', o_orderkey % 10, '.xls') END AS source_file FROM orders
"""


def source_files(spark, d):
    orders = spread(st.table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate")
    m = F.col("o_orderkey") % 4
    name = (F.when(m == 0, F.concat(F.lit("Purchase "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(".xlsx")))
             .when(m == 1, F.concat(F.lit("sales-"), F.date_format("o_orderdate", "yyyy"), F.lit(".csv")))
             .when(m == 2, F.concat(F.lit("Bank_Statement_"), F.col("o_custkey"), F.lit(".v2.csv")))
             .otherwise(F.concat(F.lit("MARCH market-200"), F.col("o_orderkey") % 10, F.lit(".xls"))))
    return orders.select("o_orderkey", name.alias("source_file"))


STEM = "regexp_replace(source_file, '(.)\\.[^.]*$', '\\1')"
TABLE_NAME = f"replace(replace(lower({STEM}), ' ', '_'), '-', '_')"

# columns of a catalog table by its kind
COLUMN_LIST = """CASE WHEN starts_with(table_name, 'purchase') THEN 'bill_no,vendor,total_value,bill_date'
  WHEN starts_with(table_name, 'sales') THEN 'invoice_no,customer,total_value,date'
  WHEN starts_with(table_name, 'vendor') THEN 'Vendor,rating,month' ELSE 'id,date,credit,debit,balance' END"""
COLUMN_LIST_SPARK = COLUMN_LIST.replace("starts_with", "startswith")


def catalog_columns(spark, d):
    tables = st.from_sql(spark, d, st.CATALOG_SQL)
    cols = tables.select("table_name", F.posexplode(F.split(F.expr(COLUMN_LIST_SPARK), ",")).alias("pos", "column_name"))
    kind = F.when(F.col("column_name").isin("total_value", "rating", "credit", "debit", "balance"), "number").when(
        F.col("column_name").contains("date"), "date").otherwise("text")
    return cols.withColumn("kind", kind)


COLUMNS_DUCK = f"""
cat AS ({st.CATALOG_DUCK}),
cols AS (SELECT table_name, unnest(string_split({COLUMN_LIST}, ',')) AS column_name,
                generate_subscripts(string_split({COLUMN_LIST}, ','), 1) - 1 AS pos FROM cat)
"""


# --- profiles ------------------------------------------------------------------------

@query("m2_table_statistics", st.WITH_LEDGER + """
SELECT source_table, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, count(DISTINCT vendor) AS vendors, count(DISTINCT item) AS items,
       CAST(sum(taxable_value) AS DOUBLE) AS taxable, CAST(sum(total_value) AS DOUBLE) AS total,
       count(*) FILTER (WHERE payment_date IS NULL) * 100.0::DOUBLE / count(*)::DOUBLE AS unpaid_share
FROM purchase_ledger GROUP BY 1
""")
def m2_table_statistics(spark, d):
    df = st.purchase_ledger(spark, d, "source_table", "vendor", "item", "payment_date", "taxable_value", "total_value")
    return catalog.profile(df).select(
        "source_table", "row_count", "column_count", F.col("unique_counts.vendor").alias("vendors"), F.col("unique_counts.item").alias("items"),
        F.col("numeric_sums.taxable_value").alias("taxable"), F.col("numeric_sums.total_value").alias("total"),
        F.col("null_percentages.payment_date").alias("unpaid_share"))


@query("m3_date_column", """
SELECT 'o_orderdate' AS date_column, min(CAST(o_orderdate AS DATE)) AS min_date, max(CAST(o_orderdate AS DATE)) AS max_date FROM orders
""")
def m3_date_column(spark, d):
    orders = st.table(spark, d, "orders")
    day = catalog.date_column(orders)
    return orders.agg(F.min(F.col(day).cast("date")).alias("min_date"), F.max(F.col(day).cast("date")).alias("max_date")
                      ).withColumn("date_column", F.lit(day))


_SPANS = """
spans AS (
  SELECT concat('v', l_suppkey) AS span_id, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem GROUP BY l_suppkey
  UNION ALL SELECT concat('c', o_custkey, '-', year(o_orderdate)), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders GROUP BY o_custkey, year(o_orderdate))
"""
_PERIOD = """CASE WHEN year(a) = year(b) AND month(a) = month(b) THEN strftime(a, '%B %Y')
  WHEN year(a) = year(b) THEN concat(strftime(a, '%b'), ' - ', strftime(b, '%b %Y'))
  ELSE concat('FY ', year(a) - CASE WHEN month(a) >= 4 THEN 0 ELSE 1 END, '-', right(CAST(year(b) + CASE WHEN month(b) >= 4 THEN 1 ELSE 0 END AS VARCHAR), 2)) END"""


@query("m4_period_label", f"WITH {_SPANS} SELECT span_id, {_PERIOD} AS period FROM spans")
def m4_period_label(spark, d):
    line, orders = st.table(spark, d, "lineitem"), st.table(spark, d, "orders")
    a = line.groupBy(F.concat(F.lit("v"), F.col("l_suppkey")).alias("span_id")).agg(
        F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    b = orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey"), F.lit("-"), F.year("o_orderdate")).alias("span_id")).agg(
        F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return a.unionByName(b).select("span_id", catalog.period_label(F.col("a"), F.col("b")).alias("period"))


def _months_duck(text, short):
    items = ", ".join(f"CASE WHEN contains({text}, {lit(m[:3] if short else m)}) THEN {lit(m)} END" for m in fv.MONTHS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


_KEYWORDS = f"""
array_to_string(list_sort(list_distinct(list_concat(
  list_filter(list_concat(
    string_split_regex(replace(replace(lower({STEM}), '_', ' '), '-', ' '), '\\s+'),
    string_split_regex(replace({TABLE_NAME}, '_', ' '), '\\s+'),
    ['bill', 'no', 'vendor', 'name', 'total', 'value']), lambda w: length(w) > 2),
  {_months_duck(f"lower(concat({TABLE_NAME}, ' ', source_file))", True)})))[1:15], ',')
"""


@query("m5_keywords", f"SELECT o_orderkey, {_KEYWORDS} AS keywords FROM ({FILE_DUCK})")
def m5_keywords(spark, d):
    from khata.functions.text import table_name_of
    cols = F.array(*[F.lit(c) for c in ("Bill_No", "vendor_name", "total_value")])
    kw = catalog.keywords(F.col("source_file"), table_name_of(F.col("source_file")), cols)
    return source_files(spark, d).select("o_orderkey", F.array_join(kw, ",").alias("keywords"))


_MONTH = f"({_months_duck('lower(source_file)', False)})[1]"


@query("m6_description", f"""
SELECT o_orderkey, CASE WHEN y <> '' AND m IS NOT NULL THEN concat('Data for ', upper(m[1]), m[2:], ' ', y)
  WHEN y <> '' THEN concat('Data from ', y) ELSE concat('Data from ', replace(replace({STEM}, '_', ' '), '-', ' ')) END AS description
FROM (SELECT *, regexp_extract(source_file, '20\\d{{2}}', 0) AS y, {_MONTH} AS m FROM ({FILE_DUCK}))
""")
def m6_description(spark, d):
    return source_files(spark, d).select("o_orderkey", catalog.description(F.col("source_file")).alias("description"))


def _described(source):
    """``description`` of the files of a DuckDB relation with ``source_file``."""
    return f"""(SELECT *, CASE WHEN y <> '' AND m IS NOT NULL THEN concat('Data for ', upper(m[1]), m[2:], ' ', y)
  WHEN y <> '' THEN concat('Data from ', y) ELSE concat('Data from ', replace(replace({STEM}, '_', ' '), '-', ' ')) END AS description
FROM (SELECT *, regexp_extract(source_file, '20\\d{{2}}', 0) AS y, {_MONTH} AS m FROM ({source})))"""


_PROFILED = ["vendor", "item", "invoice_date", "payment_date", "taxable_value", "total_value"]
_PROFILE_WORDS = _KEYWORDS.replace("['bill', 'no', 'vendor', 'name', 'total', 'value']", str([w for c in _PROFILED for w in c.split("_")]))


@query("m1_table_profile", st.WITH_LEDGER + f""",
p AS (SELECT source_table, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, 'unknown' AS data_type, min(invoice_date) AS a, max(invoice_date) AS b,
        count(DISTINCT vendor) AS vendors, count(DISTINCT item) AS items, CAST(sum(taxable_value) AS DOUBLE) AS taxable, CAST(sum(total_value) AS DOUBLE) AS total,
        {", ".join(f"round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*)::DOUBLE, 6) AS null_{c}" for c in _PROFILED)},
        concat(source_table, '.csv') AS source_file FROM purchase_ledger GROUP BY source_table)
SELECT * EXCLUDE (a, b, y, m, source_file), a AS min_date, b AS max_date, {_PERIOD} AS period, {_PROFILE_WORDS} AS keywords FROM {_described("FROM p")}
""")
def m1_table_profile(spark, d):
    df = st.purchase_ledger(spark, d, "source_table", *_PROFILED)
    source = F.concat(F.col("source_table"), F.lit(".csv"))
    return catalog.profile(df).select(
        "source_table", "row_count", "column_count", "data_type", "min_date", "max_date",
        catalog.period_label(F.col("min_date"), F.col("max_date")).alias("period"),
        catalog.description(source).alias("description"),
        F.array_join(catalog.keywords(source, F.col("source_table"), F.array(*[F.lit(c) for c in _PROFILED])), ",").alias("keywords"),
        F.col("unique_counts.vendor").alias("vendors"), F.col("unique_counts.item").alias("items"),
        F.col("numeric_sums.taxable_value").alias("taxable"), F.col("numeric_sums.total_value").alias("total"),
        *[F.round(F.col("null_percentages")[c], 6).alias(f"null_{c}") for c in _PROFILED])


_KIND = "CASE WHEN column_name IN ('total_value', 'rating', 'credit', 'debit', 'balance') THEN 'number' WHEN contains(column_name, 'date') THEN 'date' ELSE 'text' END"


@query("m7_example_questions", f"""
WITH {COLUMNS_DUCK},
k AS (SELECT *, {_KIND} AS kind FROM cols),
f AS (SELECT table_name, arg_min(lower(column_name), pos) FILTER (WHERE kind = 'number') AS n, arg_min(lower(column_name), pos) FILTER (WHERE kind = 'text') AS t,
             arg_min(lower(column_name), pos) FILTER (WHERE kind = 'date') AS d FROM k GROUP BY 1)
SELECT table_name, array_to_string(list_filter([
   CASE WHEN n IS NOT NULL THEN concat('Total of ', n) END, CASE WHEN n IS NOT NULL AND t IS NOT NULL THEN concat('Sum of ', n, ' by ', t) END,
   CASE WHEN t IS NOT NULL THEN concat('Count by ', t) END, CASE WHEN d IS NOT NULL AND n IS NOT NULL THEN concat('Trend of ', n, ' over time') END,
   concat('Show all data from ', table_name)], lambda x: x IS NOT NULL), '; ') AS example_questions
FROM f
""")
def m7_example_questions(spark, d):
    return catalog.example_questions(catalog_columns(spark, d)).withColumn("example_questions", F.array_join("example_questions", "; "))


@query("a22_data_overview", st.WITH_LEDGER + """
SELECT source_table, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, CAST(min(invoice_date) AS VARCHAR) AS min_date,
       CAST(max(invoice_date) AS VARCHAR) AS max_date, concat('payment_date: ', count(*) FILTER (WHERE payment_date IS NULL)) AS null_columns
FROM purchase_ledger GROUP BY 1
""")
def a22_data_overview(spark, d):
    df = st.purchase_ledger(spark, d, "source_table", "bill_no", "invoice_date", "payment_date", "vendor_id", "total_value")
    return catalog.overview(df).withColumn("null_columns", F.array_join("null_columns", ", "))


# --- families and relations ----------------------------------------------------------

_FAMILY = f"""
cat AS ({st.CATALOG_DUCK}),
named AS (SELECT table_name, CASE WHEN regexp_matches(table_name, {lit(fv.FAMILY_SUFFIX)}) THEN concat(regexp_extract(table_name, {lit(fv.FAMILY_SUFFIX)}, 1), '_')
                                  WHEN regexp_matches(table_name, {lit(fv.FAMILY_NUMBER)}) THEN concat(regexp_extract(table_name, {lit(fv.FAMILY_NUMBER)}, 1), '_')
                                  ELSE table_name END AS family FROM cat),
families AS (SELECT *, count(*) OVER (PARTITION BY family) AS members FROM named QUALIFY members > 1)
"""


@query("m8_table_families", f"WITH {_FAMILY} SELECT table_name, family, members FROM families")
def m8_table_families(spark, d):
    return catalog.families(st.from_sql(spark, d, st.CATALOG_SQL)).select("table_name", "family", "members")


@query("m9_family_for_question", f"""
WITH {_FAMILY},
bases AS (SELECT family, min(table_name) AS first, regexp_replace(regexp_replace(family, '_+$', ''), '[0-9]+$', '') AS base FROM families GROUP BY family),
q AS (SELECT question_id, lower(question) AS q FROM ({st.duck(st.QUESTIONS_SQL)}) WHERE {any_contains("lower(question)", fv.WANT_ALL_WORDS)}),
hit AS (SELECT q.question_id, b.family FROM q JOIN bases b ON contains(q.q, b.base) QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY b.first) = 1)
SELECT * FROM (SELECT q.question_id, coalesce(h.family, CASE WHEN (SELECT count(*) FROM bases) = 1 THEN (SELECT max(family) FROM bases) END) AS family
               FROM q LEFT JOIN hit h USING (question_id)) WHERE family IS NOT NULL
""")
def m9_family_for_question(spark, d):
    return catalog.family_for_questions(spread(st.from_sql(spark, d, st.QUESTIONS_SQL)), "question", "question_id",
                                        st.from_sql(spark, d, st.CATALOG_SQL))


# a catalog of monthly purchase tables and one consolidated table
MONTHS_DUCK = """
months AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders GROUP BY 1),
listing AS (
  SELECT row_number() OVER (ORDER BY m) AS pos, concat('purchase_', strftime(m, '%Y_%m')) AS table_name,
         ['purchase', strftime(m, '%Y'), lower(strftime(m, '%B'))] AS keywords, strftime(m, '%B %Y') AS period FROM months
  UNION ALL SELECT 100000, 'ledger_consolidated', ['ledger', 'consolidated', 'total'], '')
"""


def month_catalog(spark, d):
    months = st.table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).distinct()
    order = F.months_between(F.col("m"), F.lit("1990-01-01").cast("date")).cast("bigint")
    monthly = months.select(
        order.alias("pos"), F.concat(F.lit("purchase_"), F.date_format("m", "yyyy_MM")).alias("table_name"),
        F.array(F.lit("purchase"), F.date_format("m", "yyyy"), F.lower(F.date_format("m", "MMMM"))).alias("keywords"),
        F.date_format("m", "MMMM yyyy").alias("period"))
    whole = spark.range(1).select(
        F.lit(100000).cast("bigint").alias("pos"), F.lit("ledger_consolidated").alias("table_name"),
        F.array(F.lit("ledger"), F.lit("consolidated"), F.lit("total")).alias("keywords"), F.lit("").alias("period"))
    return monthly.unionByName(whole)


_CHOICE = f"""
WITH {MONTHS_DUCK},
q AS (SELECT question_id, lower(question) AS q FROM ({st.duck(st.QUESTIONS_SQL)})),
scored AS (
  SELECT q.question_id, t.pos, t.table_name,
    5 * len(list_filter(t.keywords, lambda w: contains(q.q, w))) + 3 * len(list_filter(string_split(t.table_name, '_'), lambda w: contains(q.q, w)))
    + CASE WHEN contains(t.table_name, 'consolidated') OR contains(t.table_name, 'all') THEN 2 ELSE 0 END
    + CASE WHEN t.period <> '' AND len(list_filter(string_split(lower(t.period), ' '), lambda w: contains(q.q, w))) > 0 THEN 4 ELSE 0 END AS score
  FROM q, listing t),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) AS place FROM scored)
"""


@query("m10_table_choice", _CHOICE + """
SELECT question_id, string_agg(concat(table_name, ':', score), ',' ORDER BY place) AS tables
FROM placed WHERE place <= 3 AND (score > 0 OR place = 1) GROUP BY 1
""")
def m10_table_choice(spark, d):
    chosen = catalog.choose_tables(spread(st.from_sql(spark, d, st.QUESTIONS_SQL)), "question", "question_id", month_catalog(spark, d))
    return chosen.select("question_id", F.array_join(F.transform(
        "tables", lambda t: F.concat(t["table_name"], F.lit(":"), t["score"])), ",").alias("tables"))


@query("t5_best_table", _CHOICE + "SELECT question_id, table_name, CAST(score AS BIGINT) AS score FROM placed WHERE place = 1")
def t5_best_table(spark, d):
    chosen = catalog.choose_tables(spread(st.from_sql(spark, d, st.QUESTIONS_SQL)), "question", "question_id", month_catalog(spark, d), n=1)
    return chosen.select("question_id", F.col("tables")[0]["table_name"].alias("table_name"), F.col("tables")[0]["score"].alias("score"))


_GENERIC = ", ".join(lit(c) for c in fv.GENERIC_COLUMNS)


@query("j13_related_tables", f"""
WITH {COLUMNS_DUCK},
c AS (SELECT table_name, lower(column_name) AS name FROM cols WHERE lower(column_name) NOT IN ({_GENERIC})),
p AS (SELECT a.table_name, b.table_name AS other, a.name FROM c a JOIN c b ON a.name = b.name AND a.table_name <> b.table_name)
SELECT t.table_name, count(DISTINCT p.other) AS related FROM cat t LEFT JOIN p USING (table_name) GROUP BY 1
""")
def j13_related_tables(spark, d):
    return catalog.related_counts(catalog_columns(spark, d)).select("table_name", "related")


@query("m11_relation_names", f"""
WITH {COLUMNS_DUCK},
c AS (SELECT table_name, lower(column_name) AS name FROM cols WHERE lower(column_name) NOT IN ({_GENERIC})),
p AS (SELECT a.table_name, a.name FROM c a JOIN c b ON a.name = b.name AND a.table_name <> b.table_name)
SELECT t.table_name, coalesce(string_agg(DISTINCT p.name, ',' ORDER BY p.name), '') AS via FROM cat t LEFT JOIN p USING (table_name) GROUP BY 1
""")
def m11_relation_names(spark, d):
    return catalog.related_counts(catalog_columns(spark, d)).select("table_name", F.array_join("via", ",").alias("via"))


@query("u4_column_sets", f"""
WITH {COLUMNS_DUCK}, s AS (SELECT table_name, list(lower(column_name) ORDER BY pos) AS names FROM cols GROUP BY 1)
SELECT table_name, array_to_string(list_filter(names, lambda c: list_contains(['vendor', 'total_value', 'date', 'bill_no'], c)), ',') AS shared,
       array_to_string(list_filter(names, lambda c: NOT list_contains(['vendor', 'total_value', 'date', 'bill_no'], c)), ',') AS own FROM s
""")
def u4_column_sets(spark, d):
    tables = st.from_sql(spark, d, st.CATALOG_SQL)
    names = F.split(F.lower(F.expr(COLUMN_LIST_SPARK)), ",")
    common = F.array(*[F.lit(c) for c in ("vendor", "total_value", "date", "bill_no")])
    return tables.select("table_name", F.array_join(F.array_intersect(names, common), ",").alias("shared"),
                         F.array_join(F.array_except(names, common), ",").alias("own"))


@query("m14_table_role", f"""
SELECT CASE WHEN contains(lower(table_name), 'purchase') THEN 'purchase' WHEN contains(lower(table_name), 'sales') THEN 'sales' END AS role,
       count(*) AS tables FROM ({st.CATALOG_DUCK}) GROUP BY 1
""")
def m14_table_role(spark, d):
    tables = st.from_sql(spark, d, st.CATALOG_SQL)
    return tables.groupBy(roles.table_role(F.col("table_name")).alias("role")).agg(F.count(F.lit(1)).alias("tables"))


@query("m12_catalog_lines", st.WITH_LEDGER + """
SELECT source_table, concat('Data from ', replace(source_table, '_', ' '), ' (6 columns, ', count(*), ' rows)') AS line
FROM purchase_ledger WHERE source_table NOT LIKE '%20%' GROUP BY 1
UNION ALL SELECT source_table, concat('Data from ', right(source_table, 4), ' (6 columns, ', count(*), ' rows)')
FROM purchase_ledger WHERE source_table LIKE '%20%' GROUP BY 1
""")
def m12_catalog_lines(spark, d):
    df = st.purchase_ledger(spark, d, "source_table", "bill_no", "invoice_date", "payment_date", "vendor_id", "total_value", "item")
    p = df.groupBy("source_table").agg(F.count(F.lit(1)).alias("rows"))
    return p.select("source_table", catalog.brief_line(
        catalog.description(F.concat("source_table", F.lit(".csv"))), F.lit(len(df.columns) - 1), F.col("rows")).alias("line"))


@query("m12_schema_texts", f"""
WITH {COLUMNS_DUCK},
span AS (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem),
listing AS (SELECT table_name, concat(table_name, '.csv') AS source_file, count(*) AS n,
  string_agg(concat('    "', column_name, '" (', upper({_KIND}), ')'), chr(10) ORDER BY pos) AS body FROM cols GROUP BY table_name)
SELECT table_name, concat('TABLE: ', table_name, chr(10), '  Source: ', source_file, chr(10), '  Description: ', description, chr(10),
  '  Date range: ', a, ' to ', b, ' (', {_PERIOD}, ')', chr(10), '  Columns:', chr(10), body, chr(10), '  Total rows: ', n) AS schema_text
FROM {_described("FROM listing")}, span
""")
def m12_schema_texts(spark, d):
    cols = catalog_columns(spark, d).withColumn("type", F.upper("kind"))
    spans = st.table(spark, d, "lineitem").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    a, b = spans.select("a").scalar(), spans.select("b").scalar()
    listing = cols.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    listing = (listing.select("*", F.concat("table_name", F.lit(".csv")).alias("source_file"), a.alias("a"), b.alias("b"))
               .withColumn("description", catalog.description(F.col("source_file")))
               .withColumn("period", catalog.period_label(F.col("a"), F.col("b")))
               .withColumn("min_date", F.col("a").cast("string")).withColumn("max_date", F.col("b").cast("string")))
    return catalog.schema_text(listing, cols)


@query("m13_column_info", """
SELECT column_name, type, filled FROM (
  SELECT 'event_id' AS column_name, 'BIGINT' AS type, count(event_id) AS filled FROM events UNION ALL SELECT 'ts', 'TIMESTAMP_NTZ', count(ts) FROM events
  UNION ALL SELECT 'user_id', 'BIGINT', count(user_id) FROM events UNION ALL SELECT 'event_type', 'STRING', count(event_type) FROM events
  UNION ALL SELECT 'value', 'DOUBLE', count(value) FROM events UNION ALL SELECT 'props', 'STRING', count(props) FROM events)
""")
def m13_column_info(spark, d):
    events = st.table(spark, d, "events")
    info = catalog.column_info(spark, {"events": events}).select("column_name", "type")
    filled = events.agg(*[F.count(c).alias(c) for c in events.columns]).unpivot([], events.columns, "column_name", "filled")
    return info.join(filled, "column_name")


_LEDGER_SAMPLE = ["bill_no", "item", "vendor", "total_value"]


@query("m1_catalog_records", st.WITH_LEDGER + """,
firsts AS (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY bill_no, item, vendor, total_value) AS place FROM purchase_ledger
           QUALIFY place <= 3)
SELECT source_table, (SELECT count(*) FROM purchase_ledger p WHERE p.source_table = f.source_table) AS row_count,
       string_agg(concat(bill_no, '|', item, '|', vendor), ';' ORDER BY place) AS sample,
       array_to_string(list_sort(list_distinct(list(bill_no))), ',') AS bill_values,
       concat('Total of total_value; Sum of total_value by bill_no; Count by bill_no; Show all data from ', source_table) AS questions,
       (SELECT count(DISTINCT source_table) - 1 FROM purchase_ledger) AS related, 'bill_no,item,total_value,vendor' AS via
FROM firsts f GROUP BY source_table
""")
def m1_catalog_records(spark, d):
    found = catalog.records(st.purchase_ledger(spark, d, "source_table", *_LEDGER_SAMPLE), _LEDGER_SAMPLE)
    return found.select(
        "source_table", "row_count", F.array_join(F.transform("sample_rows", lambda r: F.concat_ws(
            "|", r["bill_no"], r["item"], r["vendor"])), ";").alias("sample"),
        F.array_join(F.array_sort(F.col("columns")[0]["sample_values"]), ",").alias("bill_values"), F.array_join("example_questions", "; ").alias("questions"),
        "related", F.array_join("related_via", ",").alias("via"))


@query("m12_relation_lines", f"""
WITH {COLUMNS_DUCK},
c AS (SELECT table_name, lower(column_name) AS name FROM cols WHERE lower(column_name) NOT IN ({_GENERIC})),
one AS (SELECT min(table_name) AS t FROM cat WHERE starts_with(table_name, 'purchase'))
SELECT concat('  ', t, ' ↔ ', b.table_name, ' (via ', string_agg(DISTINCT b.name, ', ' ORDER BY b.name), ')') AS line
FROM one, c a, c b WHERE a.table_name = t AND a.name = b.name AND b.table_name <> t GROUP BY t, b.table_name
""")
def m12_relation_lines(spark, d):
    columns = catalog_columns(spark, d)
    first = columns.where(F.col("table_name").startswith("purchase")).agg(F.min("table_name").alias("t")).first()["t"]
    return catalog.relation_lines(columns, first)
