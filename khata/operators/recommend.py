"""Recommendations from data quality, audit and strategy results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import strip

FIELDS = ["grp", "seq", "title", "description", "category", "priority", "impact", "effort",
          "actions", "related", "deadline", "savings"]


def _rec(df: DataFrame, grp: int, seq: Column, title: Column, description: Column, category: str, priority: str,
         impact: int, effort: int, actions: str, related: Column | None = None,
         deadline: str | None = None, savings: Column | None = None) -> DataFrame:
    text_list = "array<string>"
    return df.select(
        F.lit(grp).alias("grp"), seq.cast("string").alias("seq"), title.alias("title"), description.alias("description"),
        F.lit(category).alias("category"), F.lit(priority).alias("priority"),
        F.lit(impact).cast("bigint").alias("impact"), F.lit(effort).cast("bigint").alias("effort"),
        F.array(*[F.lit(a) for a in fv.ACTIONS[actions]]).alias("actions"),
        (related if related is not None else F.array()).cast(text_list).alias("related"),
        F.lit(deadline).cast("string").alias("deadline"),
        (savings if savings is not None else F.lit(None)).cast("double").alias("savings"))


def first_critical(issues: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` critical issues in issue order, numbered."""
    top = issues.where(F.col("severity") == "critical").orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def recommendations(null_counts: DataFrame, critical: DataFrame, forecast: DataFrame, scores: DataFrame,
                    with_msme_check: bool = False) -> DataFrame:
    """Rule-based recommendations, numbered in rule order.

    ``null_counts`` has source_table and total_nulls, ``critical`` comes from
    :func:`first_critical`. ``with_msme_check`` adds the vendor verification advice.
    """
    gaps = null_counts.where(F.col("total_nulls") > fv.NULLS_WORTH_REPORTING)
    deficit = (forecast.where(F.col("net") < 0)
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("net")).alias("total"),
                    F.array_sort(F.collect_list(F.struct("month_no", "period"))).alias("months"))
               .where(F.col("n") > 0))
    # both vendor rules come from one row of counts, so the scores are worked out once
    counted = scores.agg(F.count_if(F.col("score") < fv.VENDOR_RISK_SCORE).alias("weak"),
                         F.count_if(F.col("total_value") > fv.MAJOR_VENDOR_VALUE).alias("major"))
    rules = F.array_compact(F.array(
        F.when(F.col("weak") >= 2, F.struct(F.lit("weak").alias("rule"), F.col("weak").alias("n"))),
        F.when((F.col("major") > 0) & F.lit(with_msme_check), F.struct(F.lit("major").alias("rule"), F.col("major").alias("n")))))
    vendors = counted.select(F.explode(rules).alias("r")).select("r.*")
    parts = [
        _rec(gaps, 1, F.col("source_table"),
             F.concat(F.lit("Address missing data in "), F.col("source_table")),
             F.concat(F.lit("Table '"), F.col("source_table"), F.lit("' has "), F.col("total_nulls").cast("string"),
                      F.lit(" records with missing values in critical columns.")),
             "data_quality", "medium", 40, 30, "missing_data"),
        _rec(critical, 2, F.col("place"),
             F.concat(F.lit("Address critical compliance issue: "), F.col("issue_type")), F.col("description"),
             "compliance", "critical", 90, 50, "critical_issue",
             related=F.array("issue_type"), savings=F.col("amount_impact")),
        _rec(deficit, 3, F.lit(1), F.lit("Prepare for projected cash flow deficit"),
             F.concat(F.lit("Negative cash flow projected for "),
                      F.array_join(F.transform(F.slice("months", 1, 3), lambda m: m["period"]), ", "),
                      F.lit(". Total deficit: ₹"), F.format_number(F.bround("total", 0).cast("bigint"), 0)),
             "cash_flow", "high", 85, 60, "deficit"),
    ]
    weak = F.col("rule") == "weak"
    vendor_recs = vendors.select(
        F.when(weak, 4).otherwise(5).alias("grp"), F.lit("1").alias("seq"),
        F.when(weak, "Diversify vendor base to reduce risk").otherwise("Verify MSME status of major vendors").alias("title"),
        F.when(weak, F.concat(F.col("n").cast("string"), F.lit(
            " vendors have low reliability scores. Over-reliance on few vendors increases supply chain risk."))
        ).otherwise(F.concat(
            F.lit("Section 43B(h) requires payment to MSME vendors within 45 days. "), F.col("n").cast("string"),
            F.lit(" major vendors have unverified MSME status."))).alias("description"),
        F.when(weak, "vendor").otherwise("compliance").alias("category"),
        F.when(weak, "medium").otherwise("high").alias("priority"),
        F.when(weak, 60).otherwise(70).cast("bigint").alias("impact"),
        F.when(weak, 40).otherwise(30).cast("bigint").alias("effort"),
        F.when(weak, F.array(*[F.lit(a) for a in fv.ACTIONS["vendor_risk"]])).otherwise(
            F.array(*[F.lit(a) for a in fv.ACTIONS["msme_check"]])).alias("actions"),
        F.array().cast("array<string>").alias("related"),
        F.when(~weak, F.lit("Before next filing")).alias("deadline"), F.lit(None).cast("double").alias("savings"))
    parts.append(vendor_recs)
    return with_ids(reduce(DataFrame.unionByName, parts))


def with_ids(recs: DataFrame, start: int = 1) -> DataFrame:
    """Number the rows REC-001, REC-002, ... in rule order. One row per rule or table, so a plain window will do."""
    place = F.row_number().over(Window.orderBy("grp", "seq")) + (start - 1)
    return recs.withColumn("rec_id", F.format_string("REC-%03d", place))


def without_repeats(recs: DataFrame) -> DataFrame:
    """Keep the first of the recommendations with the same title, whatever its case or outer blanks."""
    rest = recs.columns
    return (recs.groupBy(F.lower(strip(F.col("title"))).alias("_t"))
            .agg(F.min_by(F.struct(*rest), F.struct("grp", "seq")).alias("_r")).select("_r.*"))


def priority_rank(priority: Column) -> Column:
    out = None
    for name, rank in fv.PRIORITY_RANKS:
        out = F.when(priority == name, rank) if out is None else out.when(priority == name, rank)
    return out.otherwise(99)


def prioritized(recs: DataFrame, n: int = fv.RECOMMENDATION_CAP) -> DataFrame:
    return recs.orderBy(priority_rank(F.col("priority")), F.desc("impact"), "rec_id").limit(n)


def totals(recs: DataFrame) -> DataFrame:
    return recs.agg(
        F.coalesce(F.sum("savings"), F.lit(0.0)).alias("total_savings"),
        F.count_if(F.col("priority") == "critical").alias("critical"),
        F.count_if(F.col("priority") == "high").alias("high"))


def summary(recs: DataFrame) -> DataFrame:
    """One row of text over an already capped list."""
    order = F.struct(priority_rank(F.col("priority")), -F.col("impact"), F.col("rec_id"))
    by_category = recs.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"),
        F.count_if(F.col("priority") == "critical").alias("critical"),
        F.count_if(F.col("priority") == "high").alias("high"))
    areas = F.transform(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "category", "n"))), 1, 3),
        lambda a: F.concat(a["category"], F.lit(" ("), a["n"].cast("string"), F.lit(")")))
    one = by_category.agg(areas.alias("areas"), F.sum("critical").alias("critical"), F.sum("high").alias("high"))
    return one.select(F.when(
        F.size("areas") == 0,
        F.lit("No specific recommendations at this time. Your business appears to be in good standing."),
    ).otherwise(F.concat_ws(
        " ",
        F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"),
                                               F.lit(" CRITICAL item(s) require immediate attention."))),
        F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"),
                                           F.lit(" HIGH priority item(s) should be addressed soon."))),
        F.concat(F.lit("Top focus areas: "), F.array_join("areas", ", ")))).alias("summary"))


def by_id(recs: DataFrame, rec_id: str) -> DataFrame:
    return recs.where(F.col("rec_id") == rec_id)


def by_category(recs: DataFrame, category: str) -> DataFrame:
    return recs.where(F.col("category") == category)


def by_priority(recs: DataFrame, priority: str) -> DataFrame:
    return recs.where(F.col("priority") == priority)


def parse_replies(df: DataFrame, reply: str, keep: list[str], start: int = 1) -> DataFrame:
    """Recommendations written as TITLE / DESCRIPTION / PRIORITY / CATEGORY / ACTIONS blocks between dashes.

    Everything stays inside arrays of the reply row: blocks without title or
    description drop out before the rest are numbered.
    """
    def field(lines, name):
        hits = F.filter(lines, lambda l: F.upper(strip(l)).startswith(f"{name}:"))
        return F.coalesce(strip(F.regexp_replace(F.get(hits, F.lit(0)), r"^[^:]*:", "")), F.lit(""))

    def actions(lines):
        clean = F.transform(lines, strip)
        heads = F.transform(clean, lambda l: F.upper(l).contains("ACTIONS"))
        start_at = F.array_position(heads, True)
        tail = F.slice(clean, start_at + 1, F.size(clean))
        ends = F.transform(tail, lambda l: (l != "") & ~l.startswith("-") & ~F.upper(l).contains("ACTIONS"))
        stop = F.array_position(ends, True)
        body = F.when(stop > 0, F.slice(tail, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(tail)
        items = F.filter(body, lambda l: l.startswith("-") & ~F.upper(l).contains("ACTIONS"))
        items = F.transform(items, lambda l: strip(F.substr(l, F.lit(2))))
        return F.when(start_at > 0, F.filter(items, lambda l: l != "")).otherwise(F.array().cast("array<string>"))

    def mapped(value, names, default):
        return F.when(F.upper(value).isin(*[n.upper() for n in names]), F.lower(value)).otherwise(F.lit(default))

    def block(text):
        lines = F.split(strip(text), "\n")
        return F.struct(field(lines, "TITLE").alias("title"), field(lines, "DESCRIPTION").alias("description"),
                        mapped(field(lines, "PRIORITY"), [p for p, _ in fv.PRIORITY_RANKS], "medium").alias("priority"),
                        mapped(field(lines, "CATEGORY"), fv.CATEGORIES, "operational").alias("category"),
                        actions(lines).alias("actions"))

    blocks = F.filter(F.transform(F.split(F.col(reply), "---"), block),
                      lambda b: (b["title"] != "") & (b["description"] != ""))
    out = df.select(*keep, F.posexplode(blocks).alias("_n", "_b")).select(*keep, "_n", "_b.*")
    impact = None
    for name, score in fv.PRIORITY_IMPACT:
        hit = F.col("priority") == name
        impact = F.when(hit, score) if impact is None else impact.when(hit, score)
    return (out.withColumn("rec_id", F.format_string("REC-%03d", F.col("_n") + start))
               .withColumn("impact", impact.cast("bigint")).withColumn("effort", F.lit(50).cast("bigint")).drop("_n"))
