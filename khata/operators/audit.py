"""Audit checks over purchase ledgers.

Each check is one nullable struct column over a ledger row. An audit puts the
checks into one array and explodes it, so the ledger is read and joined once
however many checks run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.operators.lookups import has_blocked_keyword, is_blocked_item, rate_in_description, rate_text
from khata.operators.roles import role_column, role_number, role_text

ISSUE_FIELDS = ["issue_type", "severity", "description", "amount_impact", "recommendation", "reference"]
_TYPES = {"amount_impact": "decimal(20,6)"}


def _issue(fields: list[str], **values: Column | str | None) -> Column:
    parts = []
    for f in fields:
        v = values[f]
        v = v if isinstance(v, Column) else F.lit(v)
        parts.append(v.cast(_TYPES.get(f, "string")).alias(f))
    return F.struct(*parts)


def no_issue(fields: list[str]) -> Column:
    """The check of a ledger that lacks a column it needs: it never strikes."""
    return F.when(F.lit(False), _issue(fields, **dict.fromkeys(ISSUE_FIELDS)))


def rate_issue(columns: list[str], fields: list[str] = ISSUE_FIELDS) -> Column:
    """Charged rate against ``correct_rate``, which a lookup has added."""
    if not role_column(columns, "description") or not role_column(columns, "rate"):
        return no_issue(fields)
    item = F.lower(F.coalesce(F.col(role_column(columns, "description")), F.lit("none")))
    charged = role_number(columns, "rate").cast("decimal(6,2)")
    correct = F.col("correct_rate")
    taxable = role_number(columns, "taxable")
    taxable = (F.lit(0) if taxable is None else F.coalesce(taxable, F.lit(0))).cast("decimal(14,2)")
    diff = (charged - correct) * taxable * F.lit("0.01").cast("decimal(2,2)")
    over = diff > 0
    text = F.concat(F.lit("Item '"), F.substring(item, 1, 50), F.lit("' charged at "), charged.cast("double").cast("string"),
                    F.lit("% but 2026 rate is "), rate_text(correct), F.lit("%"))
    return F.when(
        (item != "") & (F.abs(charged - correct) > F.lit(fv.RATE_TOLERANCE).cast("decimal(2,1)")),
        _issue(fields, issue_type="tax_rate_mismatch",
               severity=F.when(over, "warning").otherwise("info"),
               description=text, amount_impact=F.when(over, diff),
               recommendation=F.concat(F.lit("Verify GST rate. Potential "),
                                       F.when(over, "overpayment").otherwise("underpayment"), F.lit(".")),
               reference="GST 2026 Rate Notification"))


def blocked_issue(columns: list[str], fields: list[str] = ISSUE_FIELDS, strict: bool = False) -> Column:
    """Items whose input credit is blocked; ``strict`` asks for a whole item name."""
    if not role_column(columns, "description"):
        return no_issue(fields)
    item = F.lower(role_text(columns, "description"))
    tax = role_number(columns, "tax_amount")
    hit = is_blocked_item(item) if strict else has_blocked_keyword(item)
    return F.when(hit, _issue(
        fields, issue_type="blocked_credit", severity="warning",
        description=F.concat(F.lit("ITC blocked under Section 17(5): "), F.substring(item, 1, 50)),
        amount_impact=F.when(tax > 0, tax) if tax is not None else None,
        recommendation="Reverse this ITC as it's not eligible under Section 17(5)",
        reference="Section 17(5) CGST Act"))


def ageing_issue(columns: list[str], as_of: Column, fields: list[str] = ISSUE_FIELDS) -> Column:
    """Invoices older than 45 days, whoever the vendor and whether paid or not."""
    if not role_column(columns, "invoice_date"):
        return no_issue(fields)
    age = F.datediff(as_of, F.col(role_column(columns, "invoice_date")))
    vendor = F.coalesce(role_text(columns, "vendor"), F.lit("")) if role_column(columns, "vendor") else F.lit("")
    amount = F.coalesce(role_number(columns, "total"), F.lit(0)) if role_column(columns, "total") else F.lit(0)
    return F.when(age > fv.PAYMENT_LIMIT_DAYS, _issue(
        fields, issue_type="section_43b_h", severity="critical",
        description=F.concat(F.lit("Payment to '"), F.substring(vendor, 1, 30), F.lit("' overdue by "),
                             age - fv.PAYMENT_LIMIT_DAYS, F.lit(" days (45-day limit)")),
        amount_impact=amount,
        recommendation="If vendor is MSME, this expense may be disallowed as tax deduction",
        reference="Section 43B(h) Income Tax Act"))


def issues_from(df: DataFrame, checks: list[Column], keep: list[str]) -> DataFrame:
    """One row per check that struck. The nulls go after the explode: a function over the
    array would take the checks out of the generated code."""
    each = df.select(*keep, F.explode(F.array(*checks)).alias("_i"))
    return each.where(F.col("_i").isNotNull()).select(*keep, "_i.*")


def with_rate(ledger: DataFrame, card) -> DataFrame:
    """The ledger with ``correct_rate``; without a description column there is nothing to look up."""
    item = role_column(ledger.columns, "description")
    return rate_in_description(ledger, item, card) if item else ledger


def check_rates(ledger: DataFrame, card, keep: list[str]) -> DataFrame:
    return issues_from(with_rate(ledger, card), [rate_issue(ledger.columns)], keep)


def check_blocked(ledger: DataFrame, keep: list[str], strict: bool = False) -> DataFrame:
    return issues_from(ledger, [blocked_issue(ledger.columns, strict=strict)], keep)


def check_ageing(ledger: DataFrame, as_of: Column, keep: list[str]) -> DataFrame:
    return issues_from(ledger, [ageing_issue(ledger.columns, as_of)], keep)


def audit(ledger: DataFrame, card, as_of: Column, keep: list[str] | None = None,
          fields: list[str] = ISSUE_FIELDS) -> DataFrame:
    """All checks, one row per issue. Name only the ``fields`` you need: texts that
    nobody reads are then never built."""
    cols = ledger.columns
    return issues_from(with_rate(ledger, card), [
        rate_issue(cols, fields), blocked_issue(cols, fields), ageing_issue(cols, as_of, fields)], keep or [])


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity").agg(
        F.count(F.lit(1)).alias("issues"),
        F.coalesce(F.sum("amount_impact"), F.lit(0)).cast("double").alias("total_impact"))


def audit_totals(issues: DataFrame) -> DataFrame:
    """One row: issue counts by severity, tax savings and the amount at risk."""
    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("amount_impact"))), F.lit(0))

    def severity(s):
        return F.count_if(F.col("severity") == s).alias(s)

    return issues.agg(
        F.count(F.lit(1)).alias("issues"), severity("critical"), severity("warning"), severity("info"),
        total(F.col("issue_type") == "tax_rate_mismatch").cast("double").alias("total_savings"),
        total(F.col("severity") == "critical").cast("double").alias("total_risk"))


def audit_summary(totals: DataFrame) -> DataFrame:
    """The totals as text."""
    def money(c):
        return F.format_number(F.bround(F.col(c).cast("decimal(24,6)"), 0).cast("bigint"), 0)

    lines = [
        F.concat(F.lit("Issues Found: "), F.col("issues")),
        F.concat(F.lit("Critical: "), F.col("critical")),
        F.concat(F.lit("Warnings: "), F.col("warning")),
        F.concat(F.lit("Info: "), F.col("info")),
        F.concat(F.lit("Potential Tax Savings: ₹"), money("total_savings")),
        F.concat(F.lit("Amount at Risk: ₹"), money("total_risk")),
        F.when(F.col("critical") > 0, F.lit("Immediate attention required for critical issues!")),
    ]
    return totals.withColumn("summary", F.concat_ws("\n", *lines))
