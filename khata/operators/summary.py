"""A ledger in one pass: a small frame of mergeable figures, from which every part of the reports is projected.

A row of the summary is a table, a scoring table and a vendor, with counts, sums, extremes and the first critical issue. All
of these merge, so figures per table, per vendor or over all are sums over the summary, and the ledger is not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.operators import audit, catalog, recommend, strategy
from khata.operators.roles import role_column
from khata.session import written

SLIM = ["issue_type", "severity", "amount_impact"]
SEVERITIES = ("critical", "warning", "info")


def summarize(ledger: DataFrame, as_of: Column, null_columns: list[str] = (), issue_order: list[str] = (), card=None,
              table: str = "source_table", scored_by: str | None = None, first_columns: int = 5) -> DataFrame:
    """The summary of ``ledger``, written to the shared folder.

    ``null_columns`` are those whose gaps count against a table; ``issue_order`` orders critical issues; with a rate ``card``
    all checks of the audit are counted. ``scored_by`` is the column by which vendors are scored, by default the table.
    """
    data = [c for c in ledger.columns if c not in (table, scored_by)]
    vendor, amount = role_column(ledger.columns, "vendor"), role_column(ledger.columns, "total")
    dated = catalog.dated_column(data)
    lines = audit.with_rate(ledger, card) if card is not None else ledger
    late = audit.ageing_issue(ledger.columns, as_of)
    checks = [late] if card is None else [audit.rate_issue(ledger.columns, SLIM), audit.blocked_issue(ledger.columns, SLIM), late]
    plus = lambda parts: reduce(Column.__add__, parts)
    severity = lambda s: plus([F.count_if(c["severity"] == s) for c in checks])
    impact = lambda test: plus([F.coalesce(F.sum(F.when(test(c), c["amount_impact"])), F.lit(0)) for c in checks])
    aggs = [F.count(F.lit(1)).alias("rows"), (F.sum(amount) if amount else F.lit(0)).alias("value"),
            plus([F.count_if(F.col(c).isNull()) for c in null_columns] or [F.lit(0)]).cast("bigint").alias("nulls"),
            *[severity(s).alias(s) for s in SEVERITIES],
            impact(lambda c: c["issue_type"] == "tax_rate_mismatch").alias("savings"), impact(lambda c: c["severity"] == "critical").alias("risk"),
            *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in data[:first_columns]]]
    if dated:
        aggs += [F.min(dated).cast("string").alias("min_date"), F.max(dated).cast("string").alias("max_date")]
    if issue_order:
        own = [late[c] if c in audit.ISSUE_FIELDS else F.col(c) for c in issue_order]
        aggs.append(F.min(F.when(late.isNotNull(), F.struct(*[v.alias(f"o{i}") for i, v in enumerate(own)]))).alias("first"))
    keys = [F.col(table).alias("source_table"), F.col(scored_by or table).alias("scored_by"),
            (F.col(vendor) if vendor else F.lit(None).cast("string")).alias("vendor")]
    return written(lines.groupBy(*keys).agg(*aggs), "ledger-summary")


def null_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("source_table").agg(F.sum("nulls").alias("total_nulls"))


def vendor_scores(summary: DataFrame) -> DataFrame:
    totals = summary.where("vendor is not null").groupBy(F.col("scored_by").alias("source_table"), "vendor").agg(
        F.sum("rows").alias("transactions"), F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("total_value"))
    return strategy.scored(totals, ["source_table"], "vendor")


def monthly_average(summary: DataFrame, name: str) -> DataFrame:
    """As :func:`strategy.monthly_average` by rows."""
    months = F.coalesce(F.sum("rows"), F.lit(0)).cast("double") / F.lit(30.0)
    return summary.agg((F.coalesce(F.sum("value"), F.lit(0)).cast("double") / F.greatest(F.lit(1.0), months)).alias(name))


def forecast(sales: DataFrame, summary: DataFrame, as_of: Column) -> DataFrame:
    return strategy.projected(strategy.monthly_average(sales, "v"), monthly_average(summary, "v"), as_of)


def audit_totals(summary: DataFrame) -> DataFrame:
    """As :func:`audit.audit_totals`; of a summary that was made with a rate card."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return summary.agg(zero(F.col("critical") + F.col("warning") + F.col("info")).alias("issues"), *[zero(s).alias(s) for s in SEVERITIES],
                       zero("savings").cast("double").alias("total_savings"), zero("risk").cast("double").alias("total_risk"))


def overview(summary: DataFrame, columns: list[str], table: str = "source_table", first_columns: int = 5) -> DataFrame:
    """As :func:`catalog.overview`; ``columns`` are the ledger's."""
    data = [c for c in columns if c != table]
    dated = "min_date" in summary.columns
    dates = [F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date")] if dated else []
    wide = summary.groupBy(F.col("source_table").alias(table)).agg(
        F.sum("rows").alias("row_count"), *dates, *[F.sum(f"_n_{c}").alias(f"_n_{c}") for c in data[:first_columns]])
    return catalog.overview_rows(wide, table, data, dated, first_columns)


def first_critical(ledger: DataFrame, summary: DataFrame, as_of: Column, issue_order: list[str], table: str = "source_table", n: int = 3) -> DataFrame:
    """As :func:`recommend.first_critical`. The first ``n`` issues are in the ``n`` groups whose first issue comes first, so only
    the lines of these are looked at once more."""
    vendor = role_column(ledger.columns, "vendor")
    groups = summary.where("first is not null").orderBy("first").limit(n).select("source_table", "vendor").collect()
    same = [F.col(table).eqNullSafe(F.lit(g["source_table"])) & (F.col(vendor).eqNullSafe(F.lit(g["vendor"])) if vendor else F.lit(True)) for g in groups]
    lines = ledger.where(reduce(Column.__or__, same, F.lit(False)))
    return recommend.first_critical(audit.check_ageing(lines, as_of, [c for c in issue_order if c not in audit.ISSUE_FIELDS]), issue_order, n)
