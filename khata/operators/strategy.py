"""Vendor scores, cash-flow projection and revenue rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.operators.roles import role_column


def vendor_scores(ledger: DataFrame, by_table: bool = True) -> DataFrame:
    """Transactions, value, score and risk per vendor, per table or over the whole family."""
    vendor = role_column(ledger.columns, "vendor")
    amount = role_column(ledger.columns, "total")
    if vendor is None:  # nothing to score
        ledger, vendor = ledger.withColumn("vendor", F.lit(None).cast("string")), "vendor"
    keys = (["source_table"] if by_table else []) + [vendor]
    n = F.count(F.lit(1))
    total = F.coalesce(F.sum(amount), F.lit(0)) if amount else F.lit(0)
    out = ledger.where(F.col(vendor).isNotNull()).groupBy(*keys).agg(
        n.alias("transactions"), total.cast("double").alias("total_value"))
    return scored(out, ["source_table"] if by_table else [], vendor)


def scored(totals: DataFrame, keys: list[str], vendor: str) -> DataFrame:
    """Score and risk for each row of transactions and value."""
    score = F.least(F.lit(fv.VENDOR_SCORE_MAX),
                    F.col("transactions") * fv.VENDOR_SCORE_STEP + fv.VENDOR_BASE_SCORE)
    risks = F.array_compact(F.array(F.when(F.col("transactions") < fv.VENDOR_MIN_HISTORY, "Limited transaction history")))
    return totals.select(
        *keys, F.substring(vendor, 1, 50).alias("vendor"),
        "transactions", "total_value", score.cast("bigint").alias("score"), risks.alias("risk_factors"))


def top_vendors(scores: DataFrame, n: int = fv.VENDOR_TOP) -> DataFrame:
    ties = [c for c in ("source_table", "vendor") if c in scores.columns]
    return scores.orderBy(F.desc("score"), *ties).limit(n)


def monthly_average(ledger: DataFrame, name: str, mode: str = "rows") -> DataFrame:
    """One row: average per month over all tables.

    ``rows`` takes thirty rows for a month, ``calendar`` counts the months that occur.
    """
    amount = role_column(ledger.columns, "total")
    total = (F.coalesce(F.sum(amount), F.lit(0)) if amount else F.lit(0)).cast("double")
    if mode == "rows":
        months = F.count(F.lit(1)).cast("double") / F.lit(30.0)
    elif mode == "calendar":
        day = role_column(ledger.columns, "invoice_date")
        months = (F.count_distinct(F.trunc(F.col(day), "month")) if day else F.lit(0)).cast("double")
    else:
        raise ValueError(f"unknown mode {mode}")
    return ledger.agg((total / F.greatest(F.lit(1.0), months)).alias(name))


def cash_flow(sales: DataFrame, purchases: DataFrame, as_of: Column,
              months: int = fv.FORECAST_MONTHS, mode: str = "rows") -> DataFrame:
    """Projected inflow, outflow, tax and net for the coming months."""
    return projected(monthly_average(sales, "v", mode), monthly_average(purchases, "v", mode), as_of, months)


def projected(incoming: DataFrame, outgoing: DataFrame, as_of: Column, months: int = fv.FORECAST_MONTHS) -> DataFrame:
    """The projection from two frames of one average each."""
    averages = (incoming.sparkSession.range(1).select(incoming.scalar().alias("avg_in"), outgoing.scalar().alias("avg_out"))
                .select("*", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("i")))
    growth = F.lit(1.0) + F.col("i") * F.lit(0.05)
    day = F.date_add(as_of, F.lit(30) * (F.col("i") + 1))
    out = averages.select(
        F.col("i").cast("bigint").alias("month_no"), F.date_format(day, "MMMM yyyy").alias("period"),
        (F.col("avg_in") * growth).alias("inflows"), (F.col("avg_out") * growth).alias("outflows"),
        F.greatest(F.lit(0.5), F.lit(1.0) - F.col("i") * F.lit(0.15)).alias("confidence"))
    tax = F.greatest(F.lit(0.0), F.col("inflows") - F.col("outflows")) * F.lit(0.18) * F.lit(0.5)
    out = out.withColumn("tax", tax)
    return out.withColumn("net", F.col("inflows") - F.col("outflows") - F.col("tax"))


def top_items(sales: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` items with the highest revenue of each table, with the insight text."""
    item, amount = role_column(sales.columns, "product"), role_column(sales.columns, "total")
    if item is None or amount is None:  # no revenue by item
        sales, item, amount = sales.withColumns({"item": F.lit(None).cast("string"), "value": F.lit(0)}), "item", "value"
    revenue = sales.where(F.col(item).isNotNull()).groupBy("source_table", F.col(item).alias("item")).agg(
        F.sum(amount).alias("revenue"))
    place = F.row_number().over(Window.partitionBy("source_table").orderBy(F.desc("revenue"), "item"))
    whole = F.bround(F.col("revenue"), 0).cast("bigint")
    return (revenue.withColumn("place", place).where(F.col("place") <= n)
            .select("source_table", "item", F.col("revenue").cast("double").alias("revenue"),
                    F.col("place").cast("bigint").alias("place"),
                    F.concat(F.lit("Top revenue item: '"), F.substring("item", 1, 30), F.lit("' - ₹"),
                             F.format_number(whole, 0)).alias("insight")))


def strategy_notes(scores: DataFrame, forecast: DataFrame) -> DataFrame:
    """Notes on weak vendors, unverified MSME status, deficits and tax; or one note that there are none."""
    vendor_counts = scores.agg(
        F.count_if(F.col("score") < fv.VENDOR_RISK_SCORE).alias("weak"),
        F.count_if(F.col("total_value") > fv.MAJOR_VENDOR_VALUE).alias("major"))
    months = forecast.agg(
        F.count_if(F.col("net") < 0).alias("deficits"), F.count(F.lit(1)).alias("months"),
        F.coalesce(F.sum("tax"), F.lit(0.0)).alias("tax"))
    whole_tax = F.bround(F.col("tax"), 0).cast("bigint")

    def notes(frame, *cases):
        rows = F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(pos).alias("pos"), text.alias("note"))) for pos, cond, text in cases]))
        return frame.select(F.explode(rows).alias("n")).select("n.*")

    found = reduce(DataFrame.unionByName, [
        notes(vendor_counts,
              (1, F.col("weak") > 0, F.concat(
                  F.col("weak").cast("string"),
                  F.lit(" vendors have low reliability scores. Consider diversifying supplier base."))),
              (2, F.col("major") > 0, F.concat(
                  F.lit("Verify MSME status of "), F.col("major").cast("string"),
                  F.lit(" major vendors for Section 43B(h) compliance.")))),
        notes(months,
              (3, F.col("deficits") > 0, F.concat(
                  F.lit("Projected negative cash flow in "), F.col("deficits").cast("string"),
                  F.lit(" months. Consider accelerating receivables or deferring non-essential expenses."))),
              (4, F.col("tax") > 0, F.concat(
                  F.lit("Estimated tax liability for next "), F.col("months").cast("string"), F.lit(" months: ₹"),
                  F.format_number(whole_tax, 0), F.lit(". Plan advance tax accordingly.")))),
    ])
    none = F.array(F.struct(F.lit(0).alias("pos"), F.lit("No immediate strategic concerns identified.").alias("note")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "note")))  # at most four
    return (found.agg(rows.alias("rows"))
            .select(F.explode(F.when(F.size("rows") == 0, none).otherwise(F.col("rows"))).alias("n"))
            .select(F.col("n.pos").cast("bigint").alias("pos"), F.col("n.note").alias("note")))


def strategy_report(sales: DataFrame, purchases: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Vendor ranking, all scores, forecast, revenue insights and notes; nothing runs yet.

    The ranking is the list to show; the notes count over all vendors.
    """
    scores = vendor_scores(purchases)
    forecast = cash_flow(sales, purchases, as_of)
    return {"vendors": top_vendors(scores), "scores": scores, "forecast": forecast, "insights": top_items(sales),
            "notes": strategy_notes(scores, forecast)}
