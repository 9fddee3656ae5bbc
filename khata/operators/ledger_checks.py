"""Whole-ledger checks and outcome shares of a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions.rules import gstin_rule, tax_total_rule


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns the ledger lacks; known from the schema, nothing runs."""
    return [c for c in required if c not in df.columns]


def ledger_checks(df: DataFrame, years: tuple[int, int] = (2000, 2100), table: str = "source_table") -> DataFrame:
    """Per table: rows, totals that do not add up, zero and negative amounts, bad GSTINs and odd years."""
    total = tax_total_rule(*[F.col(c) for c in ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "total_value")],
                           fields=("is_valid", "field"))
    mismatch = ~total["is_valid"] & (total["field"] == "total_value")
    return df.groupBy(table).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(mismatch).alias("total_mismatch"),
        F.count_if(F.col("total_value") == 0).alias("zero_amount"), F.count_if(F.col("total_value") < 0).alias("negative_amount"),
        F.count_if(~gstin_rule(F.col("gstin"), fields=("is_valid",))["is_valid"]).alias("bad_gstin"),
        F.count_if(~F.year("invoice_date").between(*years)).alias("odd_year"))


def outcome_shares(runs: DataFrame, outcome: str, n: int = 5) -> DataFrame:
    """The most common outcomes with their share of all runs."""
    counts = runs.groupBy(outcome).agg(F.count(F.lit(1)).alias("runs"))
    everything = counts.agg(F.sum("runs").cast("double")).scalar()
    return counts.orderBy(F.desc("runs"), outcome).limit(n).withColumn("share", F.col("runs").cast("double") / everything)
