"""Row rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions import rules
from khata.operators import findings
from khata.operators.lookups import msme_band
from khata.plans import standins as st
from khata.plans.duck import any_contains, any_match, strip
from khata.plans.registry import query

AS_OF_SQL = f"DATE '{st.AS_OF}'"

INVOICE_NO_SQL = """
SELECT l_orderkey, l_partkey, CASE l_linenumber WHEN 2 THEN '' WHEN 3 THEN concat('  INV-', CAST(l_orderkey AS STRING), ' ')
       WHEN 4 THEN concat('INVOICE/2025/', CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING))
       WHEN 5 THEN concat('INV#', CAST(l_orderkey AS STRING)) WHEN 6 THEN NULL
       ELSE concat('BILL/', CAST(l_orderkey AS STRING)) END AS invoice_no
FROM {lineitem}
"""
AMOUNT_SQL = """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN concat(CAST(c_custkey AS STRING), '000000000')
                  WHEN 2 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) WHEN 3 THEN NULL
                  ELSE CAST(c_custkey AS STRING) END AS amount
FROM {customer}
"""
DATE_SQL = """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1998-13-01' WHEN 1 THEN '01/02/1998' WHEN 2 THEN NULL
                   ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS bill_date
FROM {orders}
"""
TENANT_SQL = """
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN concat(c_name, ' Traders-', c_mktsegment) WHEN 1 THEN ' Admin ' WHEN 2 THEN '   '
                  WHEN 3 THEN concat('a&b ', CAST(c_custkey AS STRING)) WHEN 4 THEN concat(repeat('long-', 12), CAST(c_custkey AS STRING))
                  WHEN 5 THEN '---' ELSE concat('acme corp ', CAST(c_custkey AS STRING)) END AS raw_id
FROM {customer}
"""


def _verdict(df, rule, *keep, fields=("is_valid", "level", "message")):
    return df.select(*keep, rule.alias("_v")).select(*keep, *[F.col(f"_v.{f}").alias(f) for f in fields])


def _cases(cases, otherwise):
    """is_valid, level and message columns from (condition, valid, level, message) rows."""
    whens = [(c, ok, lv, m) for c, ok, lv, m in cases]

    def column(i, name):
        body = " ".join(f"WHEN {w[0]} THEN {w[i]}" for w in whens)
        return f"CASE {body} ELSE {otherwise[i - 1]} END AS {name}"

    return ",\n ".join([column(1, "is_valid"), column(2, "level"), column(3, "message")])


GSTIN_CASES = _cases([
    ("coalesce(gstin, '') = ''", "true", "'info'", "'GSTIN not provided'"),
    ("length(v) <> 15", "false", "'error'", "concat('GSTIN must be 15 characters, got ', length(v))"),
    (f"NOT regexp_matches(v, '{fv.GSTIN_FORMAT}')", "false", "'error'", "'Invalid GSTIN format'"),
    ("NOT (CAST(substr(v, 1, 2) AS INT) BETWEEN 1 AND 37 OR CAST(substr(v, 1, 2) AS INT) IN (97, 99))", "false", "'error'",
     "concat('Invalid state code: ', CAST(substr(v, 1, 2) AS INT))"),
], ("true", "'info'", "'Valid GSTIN'"))


@query("v1_gstin", f"""
SELECT vendor_id, {GSTIN_CASES}
FROM (SELECT *, {strip("upper(gstin)")} AS v FROM (
  SELECT vendor_id, CASE vendor_id % 9 WHEN 4 THEN substr(gstin, 1, 12) WHEN 5 THEN '' WHEN 6 THEN NULL
                    WHEN 7 THEN concat(' ', lower(gstin), ' ') ELSE gstin END AS gstin FROM ({st.duck(st.VENDOR_SQL)})))
""")
def v1_gstin(spark, d):
    vendors = st.from_sql(spark, d, st.VENDOR_SQL).selectExpr(
        "vendor_id", "CASE vendor_id % 9 WHEN 4 THEN substr(gstin, 1, 12) WHEN 5 THEN '' WHEN 6 THEN NULL "
                     "WHEN 7 THEN concat(' ', lower(gstin), ' ') ELSE gstin END AS gstin")
    return _verdict(vendors, rules.gstin_rule(F.col("gstin")), "vendor_id")


HSN_CASES = _cases([
    ("coalesce(hsn, '') = ''", "true", "'warning'", "'HSN code not provided'"),
    (f"NOT regexp_matches({strip('hsn')}, '^[0-9]+$')", "false", "'error'", "'HSN code must be numeric'"),
    (f"length({strip('hsn')}) NOT IN (4, 6, 8)", "false", "'warning'",
     f"concat('HSN code should be 4, 6, or 8 digits, got ', length({strip('hsn')}))"),
], ("true", "'info'", "'Valid HSN code'"))


@query("v2_hsn", f"""
WITH {st.WITH_LEDGER.removeprefix("WITH ")}
SELECT hsn AS hsn_code, lines, {HSN_CASES}
FROM (SELECT hsn_code AS hsn, count(*) AS lines FROM purchase_ledger GROUP BY 1)
""")
def v2_hsn(spark, d):
    codes = st.purchase_ledger(spark, d, "hsn_code").groupBy("hsn_code").agg(F.count(F.lit(1)).alias("lines"))
    return _verdict(codes, rules.hsn_rule(F.col("hsn_code")), "hsn_code", "lines")


INVOICE_CASES = _cases([
    ("coalesce(invoice_no, '') = ''", "false", "'error'", "'Invoice number is required'"),
    ("length(v) > 16", "false", "'warning'", "'Invoice number exceeds 16 characters'"),
    (f"NOT regexp_matches(v, '{fv.INVOICE_NO_FORMAT}')", "false", "'warning'", "'Invoice number contains invalid characters'"),
], ("true", "'info'", "'Valid invoice number'"))


@query("v3_invoice_number", f"""
SELECT l_orderkey, l_partkey, invoice_no, {INVOICE_CASES}
FROM (SELECT *, {strip("invoice_no")} AS v FROM ({st.duck(INVOICE_NO_SQL)}))
""")
def v3_invoice_number(spark, d):
    numbers = st.from_sql(spark, d, INVOICE_NO_SQL)
    return _verdict(numbers, rules.invoice_number_rule(F.col("invoice_no")), "l_orderkey", "l_partkey", "invoice_no")


@query("v4_amount", f"""
SELECT c_custkey, amount, {_cases([
    ("x IS NULL", "false", "'error'", "'amount must be a valid number'"),
    ("x < 0", "false", "'warning'", "'amount is negative'"),
    ("x > 1000000000", "true", "'warning'", "concat('amount is very large: ₹', format('{:,}', CAST(x AS BIGINT)))"),
], ("true", "'info'", "'Valid amount'"))}
FROM (SELECT *, try_cast(amount AS DOUBLE) AS x FROM ({st.duck(AMOUNT_SQL)}))
""")
def v4_amount(spark, d):
    return _verdict(st.from_sql(spark, d, AMOUNT_SQL), rules.amount_rule(F.col("amount")), "c_custkey", "amount")


_TAX_TOTAL = """
  SELECT bill_no, item, vendor, taxable_value, total_value,
         CASE WHEN line_no = 5 THEN cgst_amount + 2 ELSE cgst_amount END AS cgst,
         CASE WHEN line_no = 5 THEN sgst_amount - 2 ELSE sgst_amount END AS sgst,
         CASE WHEN line_no = 6 THEN igst_amount + 0.5 ELSE igst_amount END AS igst FROM purchase_ledger
"""


@query("v5_tax_total", st.WITH_LEDGER + f"""
SELECT bill_no, item, vendor, CAST(total_value AS DOUBLE) AS total_value, {_cases([
    ("abs(total_value - expected) > 1", "false", "'error'",
     "concat('Tax calculation mismatch. Expected ₹', CAST(expected AS DECIMAL(20,2)), ', got ₹', CAST(total_value AS DECIMAL(20,2)))"),
    ("cgst > 0 AND sgst > 0 AND abs(cgst - sgst) > 1", "false", "'warning'",
     "concat('CGST (₹', CAST(cgst AS DECIMAL(20,2)), ') and SGST (₹', CAST(sgst AS DECIMAL(20,2)), ') should be equal')"),
    ("igst > 0 AND (cgst > 0 OR sgst > 0)", "false", "'error'", "'IGST and CGST/SGST cannot both be applied'"),
], ("true", "'info'", "'Tax calculation is correct'"))}
FROM (SELECT *, taxable_value + cgst + sgst + igst AS expected FROM ({_TAX_TOTAL}))
""")
def v5_tax_total(spark, d):
    ledger = st.purchase_ledger(spark, d, "bill_no", "line_no", "item", "vendor", "taxable_value", "total_value",
                                "cgst_amount", "sgst_amount", "igst_amount")
    five, six = F.col("line_no") == 5, F.col("line_no") == 6
    shift, half = F.lit(2), F.lit("0.5").cast("decimal(2,1)")
    rule = rules.tax_total_rule(
        F.col("taxable_value"), F.when(five, F.col("cgst_amount") + shift).otherwise(F.col("cgst_amount")),
        F.when(five, F.col("sgst_amount") - shift).otherwise(F.col("sgst_amount")),
        F.when(six, F.col("igst_amount") + half).otherwise(F.col("igst_amount")), F.col("total_value"))
    out = _verdict(ledger, rule, "bill_no", "item", "vendor", "total_value")
    return out.withColumn("total_value", F.col("total_value").cast("double"))


@query("v6_date", f"""
SELECT o_orderkey, bill_date, {_cases([
    ("bill_date IS NULL", "false", "'error'", "'bill_date is required'"),
    ("x IS NULL", "false", "'error'", "concat('Invalid date format: ', bill_date)"),
    (f"x > {AS_OF_SQL}", "false", "'warning'", "'bill_date is in the future'"),
    ("x < DATE '1996-01-01'", "false", "'warning'", "'bill_date is before 1996-01-01'"),
    ("x > DATE '1998-06-30'", "false", "'warning'", "'bill_date is after 1998-06-30'"),
], ("true", "'info'", "'Valid bill_date'"))}
FROM (SELECT *, CAST(try_strptime(bill_date, '%Y-%m-%d') AS DATE) AS x FROM ({st.duck(DATE_SQL)}))
""")
def v6_date(spark, d):
    rule = rules.date_rule(F.col("bill_date"), st.as_of(), "bill_date", F.lit("1996-01-01").cast("date"),
                           F.lit("1998-06-30").cast("date"), is_text=True)
    return _verdict(st.from_sql(spark, d, DATE_SQL), rule, "o_orderkey", "bill_date")


_ITC = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS bill_date,
       make_date(year(o_orderdate) + CASE WHEN month(o_orderdate) <= 3 THEN 0 ELSE 1 END {shift}, 11, 30) AS deadline
FROM orders
"""


def _itc_cases(as_of):
    return _cases([
        (f"{as_of} > deadline", "false", "'error'", "concat('ITC time limit expired on ', deadline)"),
        (f"date_diff('day', {as_of}, deadline) < 30", "true", "'warning'",
         f"concat('ITC deadline approaching: ', date_diff('day', {as_of}, deadline), ' days remaining')"),
    ], ("true", "'info'", "concat('ITC can be claimed. Deadline: ', deadline)"))


@query("v7_itc_limit", f"""
SELECT o_orderkey, 'as_coded' AS mode, {_itc_cases(AS_OF_SQL)} FROM ({_ITC.format(shift="+ 1")})
UNION ALL
SELECT o_orderkey, 'strict' AS mode, {_itc_cases("DATE '1998-11-10'")} FROM ({_ITC.format(shift="")})
""")
def v7_itc_limit(spark, d):
    orders = st.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("bill_date"))
    later = F.lit("1998-11-10").cast("date")
    both = orders.select("o_orderkey", F.explode(F.array(
        F.struct(F.lit("as_coded").alias("mode"), rules.itc_limit_rule(F.col("bill_date"), st.as_of()).cast(rules.VERDICT).alias("v")),
        F.struct(F.lit("strict").alias("mode"), rules.itc_limit_rule(F.col("bill_date"), later, True).cast(rules.VERDICT).alias("v")),
    )).alias("x"))
    return both.select("o_orderkey", "x.mode", "x.v.is_valid", "x.v.level", "x.v.message")


@query("v8_payment_limit", st.WITH_LEDGER + f"""
SELECT bill_no, item, vendor, {_cases([
    ("NOT msme", "true", "'info'", "'Section 43B(h) not applicable (non-MSME vendor)'"),
    ("paid > 45", "false", "'error'", "concat('Payment made after 45 days (', paid, ' days)')"),
    ("paid IS NOT NULL", "true", "'info'", "concat('Payment made within time limit (', paid, ' days)')"),
    ("age > 45", "false", "'error'", "concat('Payment overdue by ', age - 45, ' days')"),
    ("45 - age < 7", "true", "'warning'", "concat('Payment due in ', 45 - age, ' days')"),
], ("true", "'info'", "concat('Payment due in ', 45 - age, ' days')"))}
FROM (SELECT *, vendor_turnover <= 500000000 AS msme, date_diff('day', invoice_date, payment_date) AS paid,
             date_diff('day', invoice_date, {AS_OF_SQL}) AS age FROM purchase_ledger)
""")
def v8_payment_limit(spark, d):
    ledger = st.purchase_ledger(spark, d, "bill_no", "item", "vendor", "invoice_date", "payment_date", "vendor_turnover")
    msme = msme_band(F.col("vendor_turnover")).isin("micro", "small")
    rule = rules.payment_rule(F.col("invoice_date"), F.col("payment_date"), msme, st.as_of())
    return _verdict(ledger, rule, "bill_no", "item", "vendor")


_FINDINGS = f"""
facts AS (
  SELECT *, {strip("upper(vendor_gstin)")} AS g, abs(total_value - taxable_value - cgst_amount - sgst_amount - igst_amount) > 1 AS off
  FROM purchase_ledger),
found AS (
  SELECT bill_no, vendor, 'gstin' AS field, NOT (regexp_matches(g, '{fv.GSTIN_FORMAT}') AND
         (CAST(substr(g, 1, 2) AS INT) BETWEEN 1 AND 37 OR CAST(substr(g, 1, 2) AS INT) IN (97, 99))) AS bad,
         'error' AS bad_level FROM facts
  UNION ALL SELECT bill_no, vendor, 'hsn_code', NOT regexp_matches(hsn_code, '^[0-9]+$') OR length(hsn_code) NOT IN (4, 6, 8),
         CASE WHEN regexp_matches(hsn_code, '^[0-9]+$') THEN 'warning' ELSE 'error' END FROM facts
  UNION ALL SELECT bill_no, vendor, 'invoice_number', length(bill_no) > 16 OR NOT regexp_matches(bill_no, '{fv.INVOICE_NO_FORMAT}'), 'warning' FROM facts
  UNION ALL SELECT bill_no, vendor, 'invoice_date', invoice_date > {AS_OF_SQL}, 'warning' FROM facts
  UNION ALL SELECT bill_no, vendor, 'taxable_value', taxable_value < 0, 'warning' FROM facts
  UNION ALL SELECT bill_no, vendor, 'total_value', total_value < 0, 'warning' FROM facts
  UNION ALL SELECT bill_no, vendor, 'cgst_amount', cgst_amount < 0, 'warning' FROM facts
  UNION ALL SELECT bill_no, vendor, 'sgst_amount', sgst_amount < 0, 'warning' FROM facts
  UNION ALL SELECT bill_no, vendor, 'igst_amount', igst_amount < 0, 'warning' FROM facts
  UNION ALL SELECT bill_no, vendor, CASE WHEN off THEN 'total_value' END, off, 'error' FROM facts)
"""


def _transactions(spark, d):
    ledger = st.purchase_ledger(spark, d, "bill_no", "vendor", "vendor_gstin", "hsn_code", "invoice_date",
                                "taxable_value", "total_value", "cgst_amount", "sgst_amount", "igst_amount")
    return ledger.withColumnRenamed("vendor_gstin", "gstin").withColumn("invoice_number", F.col("bill_no"))


@query("v9_transaction_findings", st.WITH_LEDGER + "," + _FINDINGS + """
SELECT field, NOT bad AS is_valid, CASE WHEN bad THEN bad_level ELSE 'info' END AS level, count(*) AS findings
FROM found GROUP BY 1, 2, 3
""")
def v9_transaction_findings(spark, d):
    found = findings.check_transactions(_transactions(spark, d), st.as_of(), [], fields=("field", "is_valid", "level"))
    return found.groupBy("field", "is_valid", "level").agg(F.count(F.lit(1)).alias("findings"))


@query("a20_validation_summary", st.WITH_LEDGER + "," + _FINDINGS + """
SELECT vendor, sum(CASE WHEN bad AND bad_level = 'error' THEN 1 ELSE 0 END) = 0 AS is_valid,
       CAST(sum(CASE WHEN bad AND bad_level = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
       CAST(sum(CASE WHEN bad AND bad_level = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning_count
FROM found GROUP BY vendor
""")
def a20_validation_summary(spark, d):
    rows = findings.summarize_rows(_transactions(spark, d), st.as_of(), ["vendor"])
    return (rows.groupBy("vendor").agg(F.sum("error_count").alias("error_count"), F.sum("warning_count").alias("warning_count"))
            .withColumn("is_valid", F.col("error_count") == 0))


@query("v10_answer_arithmetic", f"""
SELECT answer_id, NOT bad AS is_valid, CASE WHEN bad THEN 'warning' ELSE 'info' END AS level,
       CASE WHEN bad THEN 'LLM appears to be doing arithmetic' ELSE 'LLM response does not contain arithmetic' END AS message
FROM (SELECT answer_id, {any_match("answer", fv.ARITHMETIC_PATTERNS)} AS bad FROM ({st.duck(st.ANSWERS_SQL)}))
""")
def v10_answer_arithmetic(spark, d):
    return _verdict(st.from_sql(spark, d, st.ANSWERS_SQL), rules.no_arithmetic_rule(F.col("answer")), "answer_id")


@query("v11_answer_citation", f"""
SELECT answer_id, true AS is_valid, CASE WHEN talks AND NOT cites THEN 'warning' ELSE 'info' END AS level,
       CASE WHEN NOT talks THEN 'Response does not discuss rules'
            WHEN NOT cites THEN 'Response discusses rules but lacks specific citations'
            ELSE 'Response includes rule citations' END AS message
FROM (SELECT answer_id, {any_contains("lower(answer)", fv.RULE_WORDS)} AS talks,
             {any_match("answer", fv.CITATION_PATTERNS)} AS cites FROM ({st.duck(st.ANSWERS_SQL)}))
""")
def v11_answer_citation(spark, d):
    return _verdict(st.from_sql(spark, d, st.ANSWERS_SQL), rules.citation_rule(F.col("answer")), "answer_id")


@query("v12_tenant_id", f"""
SELECT c_custkey, v AS tenant_id, {_cases([
    ("v = ''", "false", "'error'", "'Customer ID cannot be empty'"),
    ("NOT regexp_matches(replace(v, '_', ''), '^[\\p{L}\\p{N}]+$')", "false", "'error'",
     "concat('Customer ID must be alphanumeric with underscores only: ', v)"),
    ("length(v) > 50", "false", "'error'", "concat('Customer ID too long (max 50 chars): ', v)"),
    ("v IN ('test', 'admin', 'system', 'default')", "false", "'error'", "concat('Reserved customer ID: ', v)"),
], ("true", "'info'", "'Valid customer ID'"))}
FROM (SELECT c_custkey, replace(replace({strip("lower(raw_id)")}, ' ', '_'), '-', '_') AS v FROM ({st.duck(TENANT_SQL)}))
""")
def v12_tenant_id(spark, d):
    raw = st.from_sql(spark, d, TENANT_SQL).withColumn("tenant_id", rules.tenant_id(F.col("raw_id")))
    return _verdict(raw, rules.tenant_rule(F.col("raw_id")), "c_custkey", "tenant_id")


@query("v14_answer_checks", f"""
SELECT answer_id, length({strip("answer")}) > 10 AS has_content,
       NOT {any_contains("lower(answer)", fv.COP_OUTS)} AS no_cop_out,
       CASE WHEN query_type = 'data' THEN regexp_matches(answer, '\\d+') END AS has_numbers,
       CASE WHEN query_type = 'knowledge' THEN {any_contains("lower(answer)", fv.SOURCE_WORDS)} END AS cites_source,
       CASE WHEN seconds > 0 THEN seconds < 10 END AS acceptable_latency
FROM ({st.duck(st.ANSWERS_SQL)})
""")
def v14_answer_checks(spark, d):
    checks = rules.answer_checks(F.col("answer"), F.col("query_type"), F.col("seconds"))
    return st.from_sql(spark, d, st.ANSWERS_SQL).select("answer_id", checks.alias("c")).select("answer_id", "c.*")
