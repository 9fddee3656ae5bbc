"""Row rules: each returns one struct column with the verdict on a value.

A verdict is ``is_valid, level, message, field, value, suggestion``; ``level`` is
error, warning or info. Rules that look at the calendar take ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import contains_any, matches_any, strip

VERDICT = "struct<is_valid:boolean,level:string,message:string,field:string,value:string,suggestion:string>"


def _text(v) -> Column:
    return v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string")


FIELDS = ("is_valid", "level", "message", "field", "value", "suggestion")
# The extra field ``tally`` counts errors in its upper part and warnings in its lower
# part, so that the sum over many verdicts holds both counts.
ERROR_UNIT = 1 << 16


def _verdicts(fields):
    """Maker of verdict structs with just ``fields``: texts nobody reads are never built."""
    def verdict(ok: bool, level: str, message, field=None, value=None, suggestion=None) -> Column:
        tally = ERROR_UNIT if level == "error" and not ok else int(level == "warning")
        parts = {"is_valid": F.lit(ok), "level": F.lit(level), "tally": F.lit(tally)}
        texts = {"message": message, "field": field, "value": value, "suggestion": suggestion}
        parts |= {name: _text(v) for name, v in texts.items() if name in fields}
        return F.struct(*[parts[name].alias(name) for name in fields])

    return verdict


def first_that_holds(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F
    for condition, result in cases:
        out = out.when(condition, result)
    return out.otherwise(otherwise)


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def gstin_rule(gstin: Column, fields=FIELDS) -> Column:
    verdict = _verdicts(fields)
    v = strip(F.upper(gstin))
    state = F.substring(v, 1, 2).cast("int")
    return first_that_holds([
        (_missing(gstin), verdict(True, "info", "GSTIN not provided", "gstin")),
        (F.length(v) != 15, verdict(
            False, "error", F.concat(F.lit("GSTIN must be 15 characters, got "), F.length(v)), "gstin", v,
            "Check GSTIN format: 27AABCU9603R1ZM")),
        (~v.rlike(fv.GSTIN_FORMAT), verdict(
            False, "error", "Invalid GSTIN format", "gstin", v,
            "GSTIN format: 2 digits + 10 char PAN + entity + Z + check")),
        (~(state.between(1, 37) | state.isin(97, 99)), verdict(
            False, "error", F.concat(F.lit("Invalid state code: "), state), "gstin", v)),
    ], verdict(True, "info", "Valid GSTIN", "gstin", v))


def hsn_rule(hsn: Column, fields=FIELDS) -> Column:
    verdict = _verdicts(fields)
    v = strip(hsn)
    return first_that_holds([
        (_missing(hsn), verdict(True, "warning", "HSN code not provided", "hsn_code")),
        (~v.rlike("^[0-9]+$"), verdict(False, "error", "HSN code must be numeric", "hsn_code", v)),
        (~F.length(v).isin(4, 6, 8), verdict(
            False, "warning", F.concat(F.lit("HSN code should be 4, 6, or 8 digits, got "), F.length(v)), "hsn_code", v)),
    ], verdict(True, "info", "Valid HSN code", "hsn_code", v))


def invoice_number_rule(number: Column, fields=FIELDS) -> Column:
    verdict = _verdicts(fields)
    raw = number.cast("string")
    v, field = strip(raw), "invoice_number"
    return first_that_holds([
        (_missing(raw), verdict(False, "error", "Invoice number is required", field)),
        (F.length(v) > fv.INVOICE_NO_MAX, verdict(False, "warning", "Invoice number exceeds 16 characters", field, v)),
        (~v.rlike(fv.INVOICE_NO_FORMAT), verdict(
            False, "warning", "Invoice number contains invalid characters", field, v, "Use only alphanumeric, /, -")),
    ], verdict(True, "info", "Valid invoice number", field, v))


def amount_rule(amount: Column, field: str = "amount", fields=FIELDS) -> Column:
    """``amount`` may be a number or text; text that is no number is an error."""
    verdict = _verdicts(fields)
    number = amount.try_cast("double")
    return first_that_holds([
        (number.isNull(), verdict(False, "error", f"{field} must be a valid number", field, amount)),
        (number < 0, verdict(False, "warning", f"{field} is negative", field, amount, "Verify if this is correct")),
        (number > fv.LARGE_AMOUNT, verdict(
            True, "warning", F.concat(F.lit(f"{field} is very large: ₹"), F.format_number(number, 0)), field, amount,
            "Verify this amount")),
    ], verdict(True, "info", f"Valid {field}", field, amount))


def tax_total_rule(taxable: Column, cgst: Column, sgst: Column, igst: Column, total: Column,
                   tolerance: float = fv.TAX_TOLERANCE, fields=FIELDS) -> Column:
    """Parts against the total; a missing tax counts as zero."""
    verdict = _verdicts(fields)
    def money(c):
        return F.coalesce(c.cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))

    taxable, cgst, sgst, igst, total = (money(c) for c in (taxable, cgst, sgst, igst, total))
    expected = (taxable + cgst + sgst + igst).cast("decimal(20,2)")
    gap = F.abs(total - expected).cast("decimal(20,2)")
    tol = F.lit(tolerance).cast("decimal(20,2)")
    return first_that_holds([
        (gap > tol, verdict(
            False, "error", F.concat(F.lit("Tax calculation mismatch. Expected ₹"), expected, F.lit(", got ₹"), total),
            "total_value", total, F.concat(F.lit("Difference of ₹"), gap))),
        ((cgst > 0) & (sgst > 0) & (F.abs(cgst - sgst) > tol), verdict(
            False, "warning", F.concat(F.lit("CGST (₹"), cgst, F.lit(") and SGST (₹"), sgst, F.lit(") should be equal")),
            "tax", None, "Check if this is an intra-state transaction")),
        ((igst > 0) & ((cgst > 0) | (sgst > 0)), verdict(
            False, "error", "IGST and CGST/SGST cannot both be applied", "tax", None,
            "Use IGST for inter-state, CGST+SGST for intra-state")),
    ], verdict(True, "info", "Tax calculation is correct"))


def date_rule(value: Column, as_of: Column, field: str = "date",
              earliest: Column | None = None, latest: Column | None = None, is_text: bool = False, fields=FIELDS) -> Column:
    """``value`` is a date, or text in ``yyyy-mm-dd`` with ``is_text``."""
    verdict = _verdicts(fields)
    d = F.try_to_date(value, "yyyy-M-d") if is_text else value
    cases = [(value.isNull(), verdict(False, "error", f"{field} is required", field))]
    if is_text:
        cases.append((d.isNull(), verdict(False, "error", F.concat(F.lit("Invalid date format: "), value), field, None,
                                          "Use YYYY-MM-DD format")))
    cases.append((d > as_of, verdict(False, "warning", f"{field} is in the future", field, d)))
    if earliest is not None:
        cases.append((d < earliest, verdict(False, "warning", F.concat(F.lit(f"{field} is before "), earliest), field, d)))
    if latest is not None:
        cases.append((d > latest, verdict(False, "warning", F.concat(F.lit(f"{field} is after "), latest), field, d)))
    return first_that_holds(cases, verdict(True, "info", f"Valid {field}", field, d))


def itc_deadline(invoice_date: Column, strict: bool = False) -> Column:
    """30 November after the fiscal year of the invoice.

    The year end is 31 March. By default the deadline lies in the year after
    that year end, ``strict`` puts it in the year of the year end.
    """
    year_end = F.year(invoice_date) + F.when(F.month(invoice_date) <= 3, 0).otherwise(1)
    return F.make_date(year_end if strict else year_end + 1, F.lit(11), F.lit(30))


def itc_limit_rule(invoice_date: Column, as_of: Column, strict: bool = False, fields=FIELDS) -> Column:
    verdict = _verdicts(fields)
    deadline = itc_deadline(invoice_date, strict)
    left, field = F.datediff(deadline, as_of), "itc_eligibility"
    return first_that_holds([
        (as_of > deadline, verdict(
            False, "error", F.concat(F.lit("ITC time limit expired on "), deadline), field, invoice_date,
            "ITC cannot be claimed for this invoice")),
        (left < fv.ITC_NOTICE_DAYS, verdict(
            True, "warning", F.concat(F.lit("ITC deadline approaching: "), left, F.lit(" days remaining")), field,
            invoice_date, F.concat(F.lit("Claim ITC before "), deadline))),
    ], verdict(True, "info", F.concat(F.lit("ITC can be claimed. Deadline: "), deadline), field))


def payment_rule(invoice_date: Column, payment_date: Column, is_msme: Column, as_of: Column, fields=FIELDS) -> Column:
    """Small and micro vendors are to be paid within 45 days."""
    verdict = _verdicts(fields)
    paid_after = F.datediff(payment_date, invoice_date)
    age = F.datediff(as_of, invoice_date)
    left = F.lit(fv.PAYMENT_LIMIT_DAYS) - age
    field, late = "section_43b_h", F.lit(fv.PAYMENT_LIMIT_DAYS)
    return first_that_holds([
        (~F.coalesce(is_msme, F.lit(False)), verdict(True, "info", "Section 43B(h) not applicable (non-MSME vendor)")),
        (paid_after > late, verdict(
            False, "error", F.concat(F.lit("Payment made after 45 days ("), paid_after, F.lit(" days)")), field, None,
            "Expense may be disallowed under Section 43B(h)")),
        (payment_date.isNotNull(), verdict(
            True, "info", F.concat(F.lit("Payment made within time limit ("), paid_after, F.lit(" days)")))),
        (age > late, verdict(
            False, "error", F.concat(F.lit("Payment overdue by "), age - late, F.lit(" days")), field, None,
            "Pay immediately to avoid expense disallowance")),
        (left < fv.PAYMENT_NOTICE_DAYS, verdict(
            True, "warning", F.concat(F.lit("Payment due in "), left, F.lit(" days")), field, None,
            "Pay before 45-day limit")),
    ], verdict(True, "info", F.concat(F.lit("Payment due in "), left, F.lit(" days"))))


def no_arithmetic_rule(answer: Column, fields=FIELDS) -> Column:
    verdict = _verdicts(fields)
    field = "llm_response"
    return first_that_holds([
        (matches_any(answer, fv.ARITHMETIC_PATTERNS), verdict(
            False, "warning", "LLM appears to be doing arithmetic", field, None, "Use SQL or Python for calculations")),
    ], verdict(True, "info", "LLM response does not contain arithmetic"))


def citation_rule(answer: Column, fields=FIELDS) -> Column:
    verdict = _verdicts(fields)
    return first_that_holds([
        (~contains_any(F.lower(answer), fv.RULE_WORDS), verdict(True, "info", "Response does not discuss rules")),
        (~matches_any(answer, fv.CITATION_PATTERNS), verdict(
            True, "warning", "Response discusses rules but lacks specific citations", None, None,
            "Add section/rule numbers for verification")),
    ], verdict(True, "info", "Response includes rule citations"))


def tenant_id(raw: Column) -> Column:
    """Normalised tenant id."""
    return F.translate(strip(F.lower(raw)), " -", "__")


def tenant_rule(raw: Column, fields=FIELDS) -> Column:
    verdict = _verdicts(fields)
    v, field = tenant_id(raw), "customer_id"
    return first_that_holds([
        (_missing(v), verdict(False, "error", "Customer ID cannot be empty", field)),
        (~F.replace(v, F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$"), verdict(
            False, "error", F.concat(F.lit("Customer ID must be alphanumeric with underscores only: "), v), field, v)),
        (F.length(v) > fv.TENANT_ID_MAX, verdict(
            False, "error", F.concat(F.lit("Customer ID too long (max 50 chars): "), v), field, v)),
        (v.isin(*fv.RESERVED_TENANTS), verdict(
            False, "error", F.concat(F.lit("Reserved customer ID: "), v), field, v)),
    ], verdict(True, "info", "Valid customer ID", field, v))


def answer_checks(answer: Column, query_type: Column, seconds: Column) -> Column:
    """Automatic answer checks; a check that does not apply is null."""
    low = F.lower(answer)
    return F.struct(
        (F.length(strip(answer)) > 10).alias("has_content"),
        (~contains_any(low, fv.COP_OUTS)).alias("no_cop_out"),
        F.when(query_type == "data", answer.rlike(r"\d+")).alias("has_numbers"),
        F.when(query_type == "knowledge", contains_any(low, fv.SOURCE_WORDS)).alias("cites_source"),
        F.when(seconds > 0, seconds < 10).alias("acceptable_latency"))
