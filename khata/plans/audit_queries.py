"""Audit, strategy and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.operators import audit, catalog, recommend, report, strategy, summary
from khata.plans import standins as st
from khata.plans.duck import any_contains, lit
from khata.plans.lookup_queries import GOODS, ITEM_RATES
from khata.plans.registry import ORACLE, query
from khata.session import written

AS_OF_SQL = f"DATE '{st.AS_OF}'"
KEEP = ["source_table", "bill_no"]
LEDGER = ["source_table", "bill_no", "line_no", "invoice_date", "description", "gst_rate", "taxable_value", "cgst_amount",
          "total_value", "vendor"]

_RATE = ("CASE WHEN {r} = floor({r}) THEN CAST(CAST({r} AS INT) AS VARCHAR) ELSE CAST(CAST({r} AS DOUBLE) AS VARCHAR) END")
_WORDS = [w for g in fv.BLOCKED_KEYWORD_GROUPS for w in g]

ISSUES = f"""
card AS (SELECT pos, item_name, CAST(gst_rate AS DECIMAL(6,2)) AS gst_rate FROM {GOODS}),
item_rate AS (
  SELECT u.description, c.gst_rate FROM (SELECT DISTINCT description FROM purchase_ledger) u
  JOIN card c ON contains(lower(u.description), lower(c.item_name))
  QUALIFY row_number() OVER (PARTITION BY u.description ORDER BY c.pos) = 1),
rated AS (
  SELECT p.*, r.gst_rate AS correct, (nullif(charged_rate, 0) - r.gst_rate) * taxable_value * 0.01 AS diff
  FROM purchase_ledger p JOIN item_rate r USING (description)),
rate_issues AS (
  SELECT source_table, bill_no, 'tax_rate_mismatch' AS issue_type, CASE WHEN diff > 0 THEN 'warning' ELSE 'info' END AS severity,
         concat('Item ''', left(lower(description), 50), ''' charged at ', CAST(CAST(charged_rate AS DOUBLE) AS VARCHAR),
                '% but 2026 rate is ', {_RATE.format(r="correct")}, '%') AS description,
         CASE WHEN diff > 0 THEN diff END AS amount_impact,
         concat('Verify GST rate. Potential ', CASE WHEN diff > 0 THEN 'overpayment' ELSE 'underpayment' END, '.') AS recommendation,
         'GST 2026 Rate Notification' AS reference
  FROM rated WHERE abs(nullif(charged_rate, 0) - correct) > 0.5),
blocked_issues AS (
  SELECT source_table, bill_no, 'blocked_credit' AS issue_type, 'warning' AS severity,
         concat('ITC blocked under Section 17(5): ', left(lower(description), 50)) AS description,
         CASE WHEN cgst_amount > 0 THEN cgst_amount * 2 END AS amount_impact,
         'Reverse this ITC as it''s not eligible under Section 17(5)' AS recommendation, 'Section 17(5) CGST Act' AS reference
  FROM purchase_ledger WHERE {any_contains("lower(description)", _WORDS)}),
ageing_issues AS (
  SELECT source_table, bill_no, 'section_43b_h' AS issue_type, 'critical' AS severity,
         concat('Payment to ''', left(vendor, 30), ''' overdue by ', date_diff('day', invoice_date, {AS_OF_SQL}) - 45,
                ' days (45-day limit)') AS description,
         total_value AS amount_impact,
         'If vendor is MSME, this expense may be disallowed as tax deduction' AS recommendation,
         'Section 43B(h) Income Tax Act' AS reference
  FROM purchase_ledger WHERE date_diff('day', invoice_date, {AS_OF_SQL}) > 45),
issues AS (SELECT * FROM rate_issues UNION ALL SELECT * FROM blocked_issues UNION ALL SELECT * FROM ageing_issues)
"""
WITH_ISSUES = st.WITH_LEDGER + "," + ISSUES
_ROW = ("SELECT source_table, bill_no, issue_type, severity, description, CAST(amount_impact AS DOUBLE) AS amount_impact, "
        "recommendation, reference FROM ")


def ledger(spark, d, *columns):
    """Purchase ledger columns under the names the checks look for."""
    wanted = ["charged_rate" if c == "gst_rate" else c for c in columns]
    return st.purchase_ledger(spark, d, *wanted).withColumnRenamed("charged_rate", "gst_rate")


def _plain(issues):
    return issues.withColumn("amount_impact", F.col("amount_impact").cast("double"))


def all_issues(spark, d, keep=(), fields=audit.ISSUE_FIELDS):
    return audit.audit(ledger(spark, d, *LEDGER), ITEM_RATES, st.as_of(), list(keep), list(fields))


@query("b1_rate_check", WITH_ISSUES + _ROW + "rate_issues")
def b1_rate_check(spark, d):
    lines = ledger(spark, d, "source_table", "bill_no", "description", "gst_rate", "taxable_value")
    return _plain(audit.check_rates(lines, ITEM_RATES, KEEP))


@query("b2_blocked_credit", WITH_ISSUES + _ROW + "blocked_issues")
def b2_blocked_credit(spark, d):
    return _plain(audit.check_blocked(ledger(spark, d, "source_table", "bill_no", "description", "cgst_amount"), KEEP))


@query("b3_payment_ageing", WITH_ISSUES + _ROW + "ageing_issues")
def b3_payment_ageing(spark, d):
    lines = ledger(spark, d, "source_table", "bill_no", "invoice_date", "vendor", "total_value")
    return _plain(audit.check_ageing(lines, st.as_of(), KEEP))


@query("u2_all_issues", WITH_ISSUES + _ROW + "issues")
def u2_all_issues(spark, d):
    return _plain(all_issues(spark, d, KEEP))


_COUNTS = """
SELECT issue_type, severity, count(*) AS issues, CAST(coalesce(sum(amount_impact), 0) AS DOUBLE) AS total_impact
FROM issues GROUP BY 1, 2
"""
SHORT = ("issue_type", "severity", "amount_impact")


@query("b4_full_audit", WITH_ISSUES + _COUNTS)
def b4_full_audit(spark, d):
    return audit.issue_counts(all_issues(spark, d, fields=SHORT))


@query("a14_issues_by_severity", WITH_ISSUES + """
SELECT source_table, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info
FROM issues GROUP BY 1
""")
def a14_issues_by_severity(spark, d):
    issues = all_issues(spark, d, ["source_table"], ["severity"])
    return issues.groupBy("source_table").agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])


_TOTALS = """
SELECT count(*) AS issues, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info,
       CAST(coalesce(sum(amount_impact) FILTER (WHERE issue_type = 'tax_rate_mismatch'), 0) AS DOUBLE) AS total_savings,
       CAST(coalesce(sum(amount_impact) FILTER (WHERE severity = 'critical'), 0) AS DOUBLE) AS total_risk
FROM issues
"""


@query("a15_audit_totals", WITH_ISSUES + f"""
SELECT *, concat('Issues Found: ', issues, chr(10), 'Critical: ', critical, chr(10), 'Warnings: ', warning, chr(10), 'Info: ', info,
  chr(10), 'Potential Tax Savings: ₹', format('{{:,}}', CAST(round_even(CAST(total_savings AS DECIMAL(24,6)), 0) AS BIGINT)),
  chr(10), 'Amount at Risk: ₹', format('{{:,}}', CAST(round_even(CAST(total_risk AS DECIMAL(24,6)), 0) AS BIGINT)),
  CASE WHEN critical > 0 THEN concat(chr(10), 'Immediate attention required for critical issues!') ELSE '' END) AS summary
FROM ({_TOTALS})
""")
def a15_audit_totals(spark, d):
    return audit.audit_summary(audit.audit_totals(all_issues(spark, d, fields=SHORT)))


@query("t7_first_issues", WITH_ISSUES + f"""
SELECT * FROM ({_ROW} issues) ORDER BY source_table, bill_no, issue_type, severity, description, amount_impact LIMIT 10
""")
def t7_first_issues(spark, d):
    issues = _plain(all_issues(spark, d, KEEP))
    return issues.orderBy("source_table", "bill_no", "issue_type", "severity", "description",
                          F.asc_nulls_last("amount_impact")).limit(10)


# --- strategy ------------------------------------------------------------------------

_MONTHLY = f"""
monthly AS (SELECT concat('purchase_', strftime(invoice_date, '%Y_%m')) AS source_table, vendor, total_value FROM purchase_ledger),
vendor_scores AS (
  SELECT source_table, left(vendor, 50) AS vendor, count(*) AS transactions, CAST(sum(total_value) AS DOUBLE) AS total_value,
         least(100, 50 + 5 * count(*)) AS score
  FROM monthly GROUP BY source_table, vendor)
"""


def monthly_purchases(spark, d, *columns):
    return st.purchase_ledger(spark, d, "source_month", "vendor", "total_value", *columns).withColumnRenamed(
        "source_month", "source_table")


def _flat(scores):
    return scores.withColumn("risk_factors", F.array_join("risk_factors", "; "))


@query("a11_vendor_metrics", st.WITH_LEDGER + "," + _MONTHLY + """
SELECT *, CASE WHEN transactions < 3 THEN 'Limited transaction history' ELSE '' END AS risk_factors FROM vendor_scores
""")
def a11_vendor_metrics(spark, d):
    return _flat(strategy.vendor_scores(monthly_purchases(spark, d)))


@query("b5_vendor_scores_combined", st.WITH_LEDGER + """
SELECT left(vendor, 50) AS vendor, count(*) AS transactions, CAST(sum(total_value) AS DOUBLE) AS total_value,
       least(100, 50 + 5 * count(*)) AS score, CASE WHEN count(*) < 3 THEN 'Limited transaction history' ELSE '' END AS risk_factors
FROM purchase_ledger GROUP BY vendor
""")
def b5_vendor_scores_combined(spark, d):
    return _flat(strategy.vendor_scores(st.purchase_ledger(spark, d, "vendor", "total_value"), by_table=False))


@query("t1_top_vendors", st.WITH_LEDGER + "," + _MONTHLY + """
SELECT *, CASE WHEN transactions < 3 THEN 'Limited transaction history' ELSE '' END AS risk_factors
FROM vendor_scores ORDER BY score DESC, source_table, vendor LIMIT 20
""")
def t1_top_vendors(spark, d):
    return _flat(strategy.top_vendors(strategy.vendor_scores(monthly_purchases(spark, d))))


SALES_SQL = """
SELECT concat('sales_', CAST(year(o_orderdate) AS STRING)) AS source_table, CAST(o_orderdate AS DATE) AS invoice_date,
       concat(o_orderpriority, ' order ', o_orderstatus) AS item, CAST(o_totalprice AS DECIMAL(14,2)) AS total_value
FROM {orders}
"""


def sales(spark, d):
    return st.from_sql(spark, d, SALES_SQL)


_CASH = f"""
sales AS ({st.duck(SALES_SQL)}),
averages AS (
  SELECT (SELECT CAST(sum(total_value) AS DOUBLE) / greatest(1.0::DOUBLE, CAST(count(*) AS DOUBLE) / 30.0::DOUBLE) FROM sales) AS avg_in,
         (SELECT CAST(sum(total_value) AS DOUBLE) / greatest(1.0::DOUBLE, CAST(count(*) AS DOUBLE) / 30.0::DOUBLE) FROM purchase_ledger) AS avg_out),
flows AS (
  SELECT i AS month_no, strftime({AS_OF_SQL} + CAST(30 * (i + 1) AS INT), '%B %Y') AS period,
         avg_in * (1.0::DOUBLE + i * 0.05::DOUBLE) AS inflows, avg_out * (1.0::DOUBLE + i * 0.05::DOUBLE) AS outflows,
         greatest(0.5::DOUBLE, 1.0::DOUBLE - i * 0.15::DOUBLE) AS confidence
  FROM averages, range(3) r(i)),
forecast AS (
  SELECT *, inflows - outflows - tax AS net
  FROM (SELECT *, greatest(0.0::DOUBLE, inflows - outflows) * 0.18::DOUBLE * 0.5::DOUBLE AS tax FROM flows))
"""
WITH_CASH = st.WITH_LEDGER + "," + _CASH


def forecast(spark, d):
    return strategy.cash_flow(sales(spark, d), st.purchase_ledger(spark, d, "total_value"), st.as_of())


@query("b6_cash_flow", WITH_CASH + "SELECT * FROM forecast")
def b6_cash_flow(spark, d):
    return forecast(spark, d)


@query("a12_monthly_average", st.WITH_LEDGER + f""", sales AS ({st.duck(SALES_SQL)})
SELECT (SELECT CAST(sum(total_value) AS DOUBLE) / greatest(1.0::DOUBLE, CAST(count(*) AS DOUBLE) / 30.0::DOUBLE) FROM sales) AS by_rows,
       (SELECT CAST(sum(total_value) AS DOUBLE) / CAST(count(DISTINCT date_trunc('month', invoice_date)) AS DOUBLE) FROM sales) AS by_calendar
""")
def a12_monthly_average(spark, d):
    register = sales(spark, d)
    return spark.range(1).select(strategy.monthly_average(register, "v").scalar().alias("by_rows"),
                                 strategy.monthly_average(register, "v", "calendar").scalar().alias("by_calendar"))


_ITEMS = f"""
WITH sales AS ({st.duck(SALES_SQL)}),
revenue AS (SELECT source_table, item, sum(total_value) AS revenue FROM sales GROUP BY 1, 2)
SELECT source_table, item, CAST(revenue AS DOUBLE) AS revenue,
       row_number() OVER (PARTITION BY source_table ORDER BY revenue DESC, item) AS place,
       concat('Top revenue item: ''', left(item, 30), ''' - ₹', format('{{:,}}', CAST(round_even(revenue, 0) AS BIGINT))) AS insight
FROM revenue QUALIFY row_number() OVER (PARTITION BY source_table ORDER BY revenue DESC, item) <= 5
"""


@query("b7_top_items", _ITEMS)
def b7_top_items(spark, d):
    return strategy.top_items(sales(spark, d))


@query("a13_revenue_by_item", st.WITH_LEDGER + """
SELECT item, CAST(sum(total_value) AS DOUBLE) AS revenue FROM purchase_ledger GROUP BY item
ORDER BY sum(total_value) DESC, item LIMIT 5
""")
def a13_revenue_by_item(spark, d):
    lines = st.sales_register(spark, d, "item", "total_value")
    return (lines.groupBy("item").agg(F.sum("total_value").alias("r")).orderBy(F.desc("r"), "item").limit(5)
            .select("item", F.col("r").cast("double").alias("revenue")))


@query("b8_strategy_notes", WITH_CASH + "," + _MONTHLY + """,
v AS (SELECT count(*) FILTER (WHERE score < 60) AS weak, count(*) FILTER (WHERE total_value > 100000) AS major FROM vendor_scores),
f AS (SELECT count(*) FILTER (WHERE net < 0) AS deficits, count(*) AS months, sum(tax) AS tax FROM forecast),
notes AS (
  SELECT 1 AS pos, concat(weak, ' vendors have low reliability scores. Consider diversifying supplier base.') AS note FROM v WHERE weak > 0
  UNION ALL SELECT 2, concat('Verify MSME status of ', major, ' major vendors for Section 43B(h) compliance.') FROM v WHERE major > 0
  UNION ALL SELECT 3, concat('Projected negative cash flow in ', deficits, ' months. Consider accelerating receivables or deferring non-essential expenses.') FROM f WHERE deficits > 0
  UNION ALL SELECT 4, concat('Estimated tax liability for next ', months, ' months: ₹', format('{:,}', CAST(round_even(tax, 0) AS BIGINT)), '. Plan advance tax accordingly.') FROM f WHERE tax > 0)
SELECT CAST(pos AS BIGINT) AS pos, note FROM notes
UNION ALL SELECT 0, 'No immediate strategic concerns identified.' WHERE (SELECT count(*) FROM notes) = 0
""")
def b8_strategy_notes(spark, d):
    return strategy.strategy_notes(strategy.vendor_scores(monthly_purchases(spark, d)), forecast(spark, d))


# --- recommendations -----------------------------------------------------------------

ISSUE_ORDER = ["source_table", "bill_no", "description", "amount_impact"]
_FIRST_CRITICAL = """
first_critical AS (
  SELECT *, row_number() OVER (ORDER BY source_table, bill_no, description, amount_impact) AS place FROM ageing_issues
  QUALIFY place <= 3)
"""
_ACTIONS = {k: " | ".join(v) for k, v in fv.ACTIONS.items()}
_RECS = f"""
gaps AS (SELECT source_table, count(*) FILTER (WHERE payment_date IS NULL) AS total_nulls FROM purchase_ledger GROUP BY 1),
parts AS (
  SELECT 1 AS grp, source_table AS seq, concat('Address missing data in ', source_table) AS title,
         concat('Table ''', source_table, ''' has ', total_nulls, ' records with missing values in critical columns.') AS description,
         'data_quality' AS category, 'medium' AS priority, 40 AS impact, 30 AS effort, {lit(_ACTIONS["missing_data"])} AS actions,
         '' AS related, CAST(NULL AS VARCHAR) AS deadline, CAST(NULL AS DOUBLE) AS savings
  FROM gaps WHERE total_nulls > 10
  UNION ALL
  SELECT 2, CAST(place AS VARCHAR), concat('Address critical compliance issue: ', issue_type), description, 'compliance', 'critical', 90, 50,
         {lit(_ACTIONS["critical_issue"])}, issue_type, NULL, CAST(amount_impact AS DOUBLE) FROM first_critical
  UNION ALL
  SELECT 3, '1', 'Prepare for projected cash flow deficit',
         concat('Negative cash flow projected for ', periods, '. Total deficit: ₹', format('{{:,}}', CAST(round_even(total, 0) AS BIGINT))),
         'cash_flow', 'high', 85, 60, {lit(_ACTIONS["deficit"])}, '', NULL, NULL
  FROM (SELECT count(*) AS n, sum(abs(net)) AS total, array_to_string(list(period ORDER BY month_no)[1:3], ', ') AS periods FROM forecast WHERE net < 0)
  WHERE n > 0
  UNION ALL
  SELECT 4, '1', 'Diversify vendor base to reduce risk',
         concat(n, ' vendors have low reliability scores. Over-reliance on few vendors increases supply chain risk.'),
         'vendor', 'medium', 60, 40, {lit(_ACTIONS["vendor_risk"])}, '', NULL, NULL
  FROM (SELECT count(*) AS n FROM vendor_scores WHERE score < 60) WHERE n >= 2
  UNION ALL
  SELECT 5, '1', 'Verify MSME status of major vendors',
         concat('Section 43B(h) requires payment to MSME vendors within 45 days. ', n, ' major vendors have unverified MSME status.'),
         'compliance', 'high', 70, 30, {lit(_ACTIONS["msme_check"])}, '', 'Before next filing', NULL
  FROM (SELECT count(*) AS n FROM vendor_scores WHERE total_value > 100000) WHERE n > 0),
recs AS (SELECT *, printf('REC-%03d', row_number() OVER (ORDER BY grp, seq)) AS rec_id FROM parts),
unique_recs AS (SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY grp, seq) = 1),
ranked AS (SELECT *, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM unique_recs),
top_recs AS (SELECT * FROM ranked ORDER BY rank, impact DESC, rec_id LIMIT 10)
"""
WITH_RECS = WITH_ISSUES + "," + _CASH + "," + _MONTHLY + "," + _FIRST_CRITICAL + "," + _RECS
_REC_ROW = """
SELECT rec_id, title, description, category, priority, CAST(impact AS BIGINT) AS impact, CAST(effort AS BIGINT) AS effort,
       actions, related, deadline, savings FROM """


def critical_first(spark, d):
    lines = ledger(spark, d, "source_table", "bill_no", "invoice_date", "vendor", "total_value")
    return recommend.first_critical(audit.check_ageing(lines, st.as_of(), KEEP), ISSUE_ORDER)


def all_recommendations(spark, d):
    """From a summary of the ledger: vendors are scored by month, gaps counted by table."""
    lines = ledger(spark, d, "source_table", "source_month", "bill_no", "invoice_date", "payment_date", "vendor", "total_value")
    found = summary.summarize(lines, st.as_of(), ["payment_date"], ISSUE_ORDER, scored_by="source_month")
    critical = summary.first_critical(lines, found, st.as_of(), ISSUE_ORDER)
    return recommend.recommendations(summary.null_totals(found), critical, summary.forecast(sales(spark, d), found, st.as_of()),
                                     summary.vendor_scores(found), with_msme_check=True)


def top_recommendations(spark, d):
    """At most ten rows, written as some queries read them more than once."""
    return written(recommend.prioritized(recommend.without_repeats(all_recommendations(spark, d))), "recommendations")


def _rec_row(recs):
    return recs.select("rec_id", "title", "description", "category", "priority", "impact", "effort",
                       F.array_join("actions", " | ").alias("actions"), F.array_join("related", " | ").alias("related"),
                       "deadline", "savings")


@query("w2_first_critical", WITH_ISSUES + "," + _FIRST_CRITICAL + """
SELECT place, source_table, bill_no, description, CAST(amount_impact AS DOUBLE) AS amount_impact FROM first_critical
""")
def w2_first_critical(spark, d):
    return critical_first(spark, d).select(
        F.col("place").cast("bigint").alias("place"), "source_table", "bill_no", "description",
        F.col("amount_impact").cast("double").alias("amount_impact"))


@query("b10_recommendations", WITH_RECS + _REC_ROW + "recs")
def b10_recommendations(spark, d):
    return _rec_row(all_recommendations(spark, d))


@query("b11_without_repeats", WITH_RECS + _REC_ROW + "unique_recs")
def b11_without_repeats(spark, d):
    return _rec_row(recommend.without_repeats(all_recommendations(spark, d)))


@query("b12_prioritized", WITH_RECS + _REC_ROW + "top_recs")
def b12_prioritized(spark, d):
    return _rec_row(top_recommendations(spark, d))


_SUMMARY = """
areas AS (SELECT category, count(*) AS n, min(rank * 100000 - impact * 100) AS first FROM top_recs GROUP BY 1
          ORDER BY n DESC, first LIMIT 3),
one AS (SELECT count(*) AS n, count(*) FILTER (WHERE priority = 'critical') AS critical, count(*) FILTER (WHERE priority = 'high') AS high,
               coalesce(sum(savings), 0.0) AS total_savings FROM top_recs)
SELECT total_savings, critical, high, CASE WHEN n = 0 THEN 'No specific recommendations at this time. Your business appears to be in good standing.'
  ELSE concat_ws(' ', CASE WHEN critical > 0 THEN concat(critical, ' CRITICAL item(s) require immediate attention.') END,
                 CASE WHEN high > 0 THEN concat(high, ' HIGH priority item(s) should be addressed soon.') END,
                 concat('Top focus areas: ', (SELECT string_agg(concat(category, ' (', n, ')'), ', ' ORDER BY n DESC, first) FROM areas))) END AS summary
FROM one
"""


@query("b13_summary", WITH_RECS + "," + _SUMMARY)
def b13_summary(spark, d):
    recs = top_recommendations(spark, d)
    return recommend.totals(recs).select("*", recommend.summary(recs).scalar().alias("summary"))


@query("a21_recommendation_totals", WITH_RECS + """
SELECT category, count(*) AS recommendations, CAST(sum(savings) AS DOUBLE) AS savings FROM top_recs GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 3
""")
def a21_recommendation_totals(spark, d):
    return (top_recommendations(spark, d).groupBy("category")
            .agg(F.count(F.lit(1)).alias("recommendations"), F.sum("savings").alias("savings"))
            .orderBy(F.desc("recommendations"), "category").limit(3))


@query("b14_filtered", WITH_RECS + """
SELECT rec_id, title, 'id' AS picked_by FROM top_recs WHERE rec_id = 'REC-001'
UNION ALL SELECT rec_id, title, 'category' FROM top_recs WHERE category = 'compliance'
UNION ALL SELECT rec_id, title, 'priority' FROM top_recs WHERE priority = 'medium'
""")
def b14_filtered(spark, d):
    recs = top_recommendations(spark, d)
    picks = [("id", recommend.by_id(recs, "REC-001")), ("category", recommend.by_category(recs, "compliance")),
             ("priority", recommend.by_priority(recs, "medium"))]
    out = [p.select("rec_id", "title", F.lit(n).alias("picked_by")) for n, p in picks]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _duck_field(name):
    hit = f"list_filter(lines, lambda l: starts_with(upper(trim(l)), '{name}:'))[1]"
    return f"coalesce(trim(regexp_replace({hit}, '^[^:]*:', '')), '')"


@query("b15_parsed_replies", f"""
WITH blocks AS (
  SELECT reply_id, u.n, string_split(trim(u.b, concat(' ', chr(10))), chr(10)) AS lines
  FROM ({st.duck(st.ADVICE_SQL)}), LATERAL (SELECT unnest(string_split(reply, '---')) AS b, generate_subscripts(string_split(reply, '---'), 1) AS n) u),
parsed AS (
  SELECT reply_id, n, {_duck_field("TITLE")} AS title, {_duck_field("DESCRIPTION")} AS description,
         {_duck_field("PRIORITY")} AS p, {_duck_field("CATEGORY")} AS c,
         list_transform(lines, lambda l: trim(l)) AS clean FROM blocks),
kept AS (
  SELECT *, list_position(list_transform(clean, lambda l: contains(upper(l), 'ACTIONS')), true) AS head,
         CASE WHEN upper(p) IN ('CRITICAL','HIGH','MEDIUM','LOW') THEN lower(p) ELSE 'medium' END AS priority,
         CASE WHEN upper(c) IN ({", ".join(lit(x.upper()) for x in fv.CATEGORIES)}) THEN lower(c) ELSE 'operational' END AS category
  FROM parsed WHERE title <> '' AND description <> ''),
tails AS (SELECT *, CASE WHEN head > 0 THEN clean[head + 1:] ELSE [] END AS tail FROM kept),
bodies AS (
  SELECT *, list_position(list_transform(tail, lambda l: l <> '' AND NOT starts_with(l, '-') AND NOT contains(upper(l), 'ACTIONS')), true) AS stop
  FROM tails)
SELECT reply_id, printf('REC-%03d', row_number() OVER (PARTITION BY reply_id ORDER BY n)) AS rec_id, title, description, priority, category,
       CAST(CASE priority WHEN 'critical' THEN 95 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 ELSE 25 END AS BIGINT) AS impact,
       CAST(50 AS BIGINT) AS effort,
       coalesce(array_to_string(list_filter(list_transform(list_filter(CASE WHEN stop > 0 THEN tail[1:stop - 1] ELSE tail END,
         lambda l: starts_with(l, '-')), lambda l: trim(substr(l, 2))), lambda l: l <> ''), ' | '), '') AS actions
FROM bodies
""")
def b15_parsed_replies(spark, d):
    out = recommend.parse_replies(st.from_sql(spark, d, st.ADVICE_SQL), "reply", ["reply_id"])
    return out.withColumn("actions", F.array_join("actions", " | "))


def _lines(section, source, keys=(), texts=(), amounts=()):
    """Report lines of a section in DuckDB; ``texts`` and ``amounts`` are names of columns."""
    fields = [f"{{'field': '{t}', 'text': CAST({t} AS VARCHAR), 'amount': CAST(NULL AS DOUBLE)}}" for t in texts]
    fields += [f"{{'field': '{n}', 'text': CAST(NULL AS VARCHAR), 'amount': round(CAST({n} AS DOUBLE), 2)}}" for n in amounts]
    item = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    return f"SELECT '{section}' AS section, {item} AS item, unnest([{', '.join(fields)}], recursive := true) FROM ({source})"


_RISKS = "CASE WHEN transactions < 3 THEN 'Limited transaction history' ELSE '' END AS risk_factors"
_FORECAST_LINES = _lines("forecast", "FROM forecast", ["period"], [], ["month_no", "inflows", "outflows", "confidence", "tax", "net"])
_NOTES = ORACLE["b8_strategy_notes"]
_NOTE_ROWS = _NOTES[_NOTES.index("v AS (SELECT count(*)"):_NOTES.index("SELECT CAST(pos AS BIGINT)")]
_NOTE_LINES = _lines("notes", """SELECT CAST(pos AS BIGINT) AS pos, note FROM notes
  UNION ALL SELECT 0, 'No immediate strategic concerns identified.' WHERE (SELECT count(*) FROM notes) = 0""", ["pos"], ["note"])
_VENDOR_FIELDS = (["source_table", "vendor"], ["risk_factors"], ["transactions", "total_value", "score"])


def _best_vendors(n):
    return f"SELECT *, {_RISKS} FROM vendor_scores ORDER BY score DESC, source_table, vendor LIMIT {n}"


@query("b9_strategy_report", WITH_CASH + "," + _MONTHLY + "," + _NOTE_ROWS + " UNION ALL ".join([
    _lines("vendors", _best_vendors(20), *_VENDOR_FIELDS), _FORECAST_LINES, _NOTE_LINES,
    _lines("insights", _ITEMS, ["source_table", "item"], ["insight"], ["revenue", "place"])]))
def b9_strategy_report(spark, d):
    parts = strategy.strategy_report(sales(spark, d), monthly_purchases(spark, d), st.as_of())
    return report.as_lines({k: v for k, v in parts.items() if k != "scores"})


_BY_TABLE = _MONTHLY.replace("concat('purchase_', strftime(invoice_date, '%Y_%m')) AS source_table", "source_table")
_REPORT_RECS = _RECS.replace("FROM ranked ORDER BY rank, impact DESC, rec_id LIMIT 10", "FROM ranked WHERE grp <> 5 ORDER BY rank, impact DESC, rec_id LIMIT 7")
_REPORT_NULLS = ", ".join(f"CASE WHEN count(*) FILTER ({c} IS NULL) > 0 THEN concat('{n}: ', count(*) FILTER ({c} IS NULL)) END" for n, c in (
    ("bill_no", "bill_no"), ("invoice_date", "invoice_date"), ("payment_date", "payment_date"), ("description", "description"), ("gst_rate", "charged_rate")))
_A15 = ORACLE["a15_audit_totals"]


@query("b16_full_report", WITH_ISSUES + "," + _CASH + "," + _BY_TABLE + "," + _FIRST_CRITICAL.replace("source_table, bill_no, description", "source_table, description")
       + "," + _REPORT_RECS + "," + _NOTE_ROWS.rstrip() + "," + _SUMMARY[:_SUMMARY.index("SELECT total_savings, critical")].rstrip() + " ".join(["", " UNION ALL ".join([
           _lines("overview", f"""SELECT source_table, count(*) AS row_count, 9 AS column_count, min(CAST(invoice_date AS VARCHAR)) AS min_date,
             max(CAST(invoice_date AS VARCHAR)) AS max_date, array_to_string(list_filter([{_REPORT_NULLS}], lambda x: x IS NOT NULL), '; ') AS null_columns
             FROM purchase_ledger GROUP BY 1""", ["source_table"], ["min_date", "max_date", "null_columns"], ["row_count", "column_count"]),
           _lines("audit", _A15[_A15.index("SELECT *, concat('Issues Found"):], [], ["summary"], ["issues", "critical", "warning", "info", "total_savings", "total_risk"]),
           _lines("vendors", _best_vendors(5), *_VENDOR_FIELDS), _FORECAST_LINES, _NOTE_LINES,
           _lines("recommendations", "SELECT * REPLACE (replace(actions, ' | ', '; ') AS actions) FROM top_recs", ["rec_id"], ["seq", "title", "description", "category", "priority", "actions", "related", "deadline"],
                  ["grp", "impact", "effort", "savings"]),
           _lines("summary", "SELECT summary FROM (" + _SUMMARY[_SUMMARY.index("SELECT total_savings, critical"):] + ")", [], ["summary"])])]))
def b16_full_report(spark, d):
    purchases = ledger(spark, d, "source_table", "bill_no", "invoice_date", "payment_date", "description", "gst_rate",
                       "taxable_value", "cgst_amount", "total_value", "vendor")
    parts = report.full_report(purchases, sales(spark, d), ITEM_RATES, st.as_of(),
                               ["source_table", "description", "amount_impact"], ["payment_date"])
    return report.as_lines(parts)
