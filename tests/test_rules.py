"""Known answers of the row rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from khata.functions import rules

D = dt.date


def ask(spark, rule, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values))
    return df.select(rule.cast(rules.VERDICT).alias("v")).select("v.*").first()


TYPES = {"s": "string", "a": "decimal(18,2)", "b": "decimal(18,2)", "c": "decimal(18,2)", "e": "decimal(18,2)", "t": "decimal(18,2)",
         "inv": "date", "paid": "date", "msme": "boolean", "day": "date"}


@pytest.mark.parametrize("value,ok,level", [
    ("27AAPFU0939F1ZV", True, "info"), ("27AAPFU0939F", False, "error"), ("INVALIDGSTIN123", False, "error"),
    ("50AAPFU0939F1ZV", False, "error"), ("", True, "info"), (None, True, "info"), (" 27aapfu0939f1zv ", True, "info"),
    ("25AAPFU0939F1ZV", True, "info")])
def test_gstin(spark, value, ok, level):
    v = ask(spark, rules.gstin_rule(F.col("s")), s=value)
    assert (v.is_valid, v.level) == (ok, level)


@pytest.mark.parametrize("value,ok", [("8471", True), ("847130", True), ("84713010", True), ("847", False), ("84AB", False)])
def test_hsn(spark, value, ok):
    assert ask(spark, rules.hsn_rule(F.col("s")), s=value).is_valid is ok


def test_hsn_missing_is_a_warning(spark):
    v = ask(spark, rules.hsn_rule(F.col("s")), s=None)
    assert (v.is_valid, v.level) == (True, "warning")


@pytest.mark.parametrize("value,ok", [("INV-2025-001", True), ("", False), ("INVOICE-2025-00001", False), ("INV#1", False)])
def test_invoice_number(spark, value, ok):
    assert ask(spark, rules.invoice_number_rule(F.col("s")), s=value).is_valid is ok


@pytest.mark.parametrize("parts,ok,level", [
    ((10000, 900, 900, 0, 11800), True, "info"), ((10000, 0, 0, 1800, 11800), True, "info"),
    ((10000, 500, 500, 0, 15000), False, "error"), ((10000, 900, 800, 0, 11700), False, "warning"),
    ((10000, 900, 900, 5, 11805), False, "error"), ((10000, None, None, None, 10001), True, "info")])
def test_tax_total(spark, parts, ok, level):
    from decimal import Decimal
    vals = dict(zip("abcet", [None if p is None else Decimal(p) for p in parts]))
    v = ask(spark, rules.tax_total_rule(*[F.col(c) for c in "abcet"]), **vals)
    assert (v.is_valid, v.level) == (ok, level)


@pytest.mark.parametrize("value,ok,level", [("10000", True, "info"), ("0", True, "info"), ("-100", False, "warning"),
                                            ("x", False, "error"), (None, False, "error"), ("2000000000", True, "warning")])
def test_amount(spark, value, ok, level):
    v = ask(spark, rules.amount_rule(F.col("s")), s=value)
    assert (v.is_valid, v.level) == (ok, level)


@pytest.mark.parametrize("value,ok,level", [("2024-02-29", True, "info"), ("2024-2-9", True, "info"), ("2023-02-29", False, "error"),
                                            ("29/02/2024", False, "error"), (None, False, "error"), ("2031-01-01", False, "warning")])
def test_date(spark, value, ok, level):
    v = ask(spark, rules.date_rule(F.col("s"), F.lit(D(2026, 1, 1)), is_text=True), s=value)
    assert (v.is_valid, v.level) == (ok, level)


@pytest.mark.parametrize("age,paid,msme,ok,level", [
    (60, None, True, False, "error"), (60, 30, True, True, "info"), (60, 50, True, False, "error"), (60, None, False, True, "info"),
    (40, None, True, True, "warning"), (10, None, True, True, "info"), (60, None, None, True, "info")])
def test_payment_limit(spark, age, paid, msme, ok, level):
    today = D(2026, 3, 1)
    inv = today - dt.timedelta(days=age)
    v = ask(spark, rules.payment_rule(F.col("inv"), F.col("paid"), F.col("msme"), F.lit(today)),
            inv=inv, paid=inv + dt.timedelta(days=paid) if paid else None, msme=msme)
    assert (v.is_valid, v.level) == (ok, level)


def test_itc_deadline_d23(spark):
    """By default one year after the strict reading."""
    day = F.col("day")
    df = spark.createDataFrame([(D(2024, 3, 31),), (D(2024, 4, 1),)], "day date")
    got = df.select(rules.itc_deadline(day), rules.itc_deadline(day, strict=True)).collect()
    assert [tuple(r) for r in got] == [(D(2025, 11, 30), D(2024, 11, 30)), (D(2026, 11, 30), D(2025, 11, 30))]


@pytest.mark.parametrize("value,want,ok", [("Acme Corp", "acme_corp", True), ("test-company", "test_company", True), ("", "", False),
                                           ("admin", "admin", False), ("x" * 100, "x" * 100, False), ("a&b", "a&b", False)])
def test_tenant(spark, value, want, ok):
    df = spark.createDataFrame([(value,)], "s string")
    got = df.select(rules.tenant_id(F.col("s")).alias("id"), rules.tenant_rule(F.col("s")).alias("v")).first()
    assert (got.id, got.v.is_valid) == (want, ok)
