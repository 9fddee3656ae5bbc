"""The five-step report: overview, audit, strategy, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.operators import audit, recommend, strategy, summary
from khata.session import written


def full_report(purchases: DataFrame, sales: DataFrame, card, as_of: Column, issue_order: list[str],
                null_columns: list[str], top: int = 7) -> dict[str, DataFrame]:
    """All steps as frames. The purchases are read once for a summary, and once more for the lines of three of its groups;
    the sales are read once.

    ``issue_order`` fixes which critical issues come first, ``null_columns`` are
    the columns whose gaps count against a table.
    """
    lines = summary.summarize(purchases, as_of, null_columns, issue_order, card)
    scores = summary.vendor_scores(lines)
    forecast = written(summary.forecast(sales, lines, as_of), "forecast")
    critical = summary.first_critical(purchases, lines, as_of, issue_order)
    recs = recommend.recommendations(summary.null_totals(lines), critical, forecast, scores)
    chosen = written(recommend.prioritized(recommend.without_repeats(recs), top), "recommendations")
    return {
        "overview": summary.overview(lines, purchases.columns),
        "audit": audit.audit_summary(summary.audit_totals(lines)),
        "vendors": strategy.top_vendors(scores, 5), "forecast": forecast, "notes": strategy.strategy_notes(scores, forecast),
        "recommendations": chosen, "summary": recommend.summary(chosen),
    }


#: Columns that name a row of each section.
KEYS = {"overview": ["source_table"], "audit": [], "vendors": ["source_table", "vendor"], "forecast": ["period"], "notes": ["pos"],
        "insights": ["source_table", "item"], "recommendations": ["rec_id"], "summary": []}


def as_lines(report: dict[str, DataFrame]) -> DataFrame:
    """The report as one frame of section, item, field, text and amount: a line for every figure or text."""
    out = None
    for section, df in report.items():
        rows = df.withColumns({f.name: F.array_join(f.name, "; ") for f in df.schema if f.dataType.typeName() == "array"})
        lines = []
        for f in rows.schema:
            if f.name not in KEYS[section]:
                is_text = f.dataType.typeName() == "string"
                text = F.col(f.name) if is_text else F.lit(None).cast("string")
                amount = F.lit(None).cast("double") if is_text else F.round(F.col(f.name).cast("double"), 2)
                lines.append(F.struct(F.lit(f.name).alias("field"), text.alias("text"), amount.alias("amount")))
        part = rows.select(F.lit(section).alias("section"), F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS[section]]).alias("item"),
                           F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    return out


def as_rows(report: dict[str, DataFrame]) -> DataFrame:
    """The report as one frame of section and JSON row."""
    out = None
    for section, df in report.items():
        part = df.select(F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
