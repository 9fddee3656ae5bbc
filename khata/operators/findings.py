"""Row rules over whole tables, exploded to one row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import rules

AMOUNT_FIELDS = ["taxable_value", "total_value", "cgst_amount", "sgst_amount", "igst_amount"]


def transaction_rules(columns: list[str], as_of: Column, fields=rules.FIELDS) -> list[Column]:
    """The rules that apply to a table with these columns, in a fixed order."""
    have = set(columns)
    out = []
    if "gstin" in have:
        out.append(rules.gstin_rule(F.col("gstin"), fields=fields))
    if "hsn_code" in have:
        out.append(rules.hsn_rule(F.col("hsn_code"), fields=fields))
    if "invoice_number" in have:
        out.append(rules.invoice_number_rule(F.col("invoice_number"), fields=fields))
    if "invoice_date" in have:
        out.append(rules.date_rule(F.col("invoice_date"), as_of, "invoice_date", fields=fields))
    out += [rules.amount_rule(F.col(f), f, fields=fields) for f in AMOUNT_FIELDS if f in have]
    if {"taxable_value", "total_value"} <= have:
        def tax(name):
            return F.col(name) if name in have else F.lit(0)
        out.append(rules.tax_total_rule(F.col("taxable_value"), tax("cgst_amount"), tax("sgst_amount"),
                                        tax("igst_amount"), F.col("total_value"), fields=fields))
    return out


def check_transactions(df: DataFrame, as_of: Column, keep: list[str], only_problems: bool = False,
                       fields=rules.FIELDS) -> DataFrame:
    """One row per rule and transaction, with just ``fields`` of the verdicts. With
    ``only_problems`` plain info verdicts are left out."""
    asked = list(fields) + (["level"] if only_problems and "level" not in fields else [])
    found = F.array(*transaction_rules(df.columns, as_of, asked))
    each = df.select(*keep, F.explode(found).alias("_v"))
    if only_problems:
        each = each.where(F.col("_v.level") != "info")
    return each.select(*keep, *[f"_v.{f}" for f in fields])


def summarize(findings: DataFrame, *keys: str) -> DataFrame:
    """Errors and warnings per key; valid when no error is left."""
    errors = F.count_if((F.col("level") == "error") & ~F.col("is_valid"))
    return findings.groupBy(*keys).agg(
        (errors == 0).alias("is_valid"), errors.alias("error_count"),
        F.count_if(F.col("level") == "warning").alias("warning_count"))


def summarize_rows(df: DataFrame, as_of: Column, keep: list[str]) -> DataFrame:
    """The same summary per transaction, inside the row: nothing is exploded or shuffled."""
    tally = reduce(Column.__add__, [v["tally"] for v in transaction_rules(df.columns, as_of, ("tally",))])
    errors = F.floor(F.col("_tally") / rules.ERROR_UNIT).cast("bigint")
    warnings = F.pmod(F.col("_tally"), F.lit(rules.ERROR_UNIT)).cast("bigint")
    return df.select(*keep, tally.alias("_tally")).select(
        *keep, errors.alias("error_count"), warnings.alias("warning_count"), (errors == 0).alias("is_valid"))
