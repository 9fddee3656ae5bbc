"""Guards and edges: what a query text may read, null keys, absent role columns, the shared folder."""

import pytest
from pyspark.sql import functions as F

from khata.operators import audit, metrics, screening, sql_reads, strategy, windows
from khata.plans.lookup_queries import ITEM_RATES


@pytest.mark.parametrize("text", [
    "SELECT * FROM text.`/etc/hosts`", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.Math', 'abs', -1)",
    "SELECT try_reflect ('java.lang.Math', 'abs', -1)", "SELECT * FROM kept_elsewhere", "SELECT * FROM {t} JOIN kept_elsewhere ON true",
    "WITH a AS (SELECT 1 AS x) SELECT * FROM a, kept_elsewhere", "SELECT * FROM (kept_elsewhere)", "SELECT * FROM (TABLE kept_elsewhere)",
    "SELECT * FROM {t} a JOIN (kept_elsewhere) b ON a.id = b.id", "SELECT * FROM {t} NATURAL JOIN(kept_elsewhere)", "SELECT * FROM `kept_elsewhere`",
    "SELECT (SELECT max(id) FROM kept_elsewhere) FROM {t}", "SELECT * FROM {t} WHERE id IN (TABLE kept_elsewhere)",
    "SELECT * FROM {t} WHERE EXISTS (FROM kept_elsewhere)", "SELECT * FROM {t}, LATERAL (SELECT * FROM kept_elsewhere)",
    "SELECT sum(id) OVER w FROM {t} WINDOW w AS (PARTITION BY (SELECT max(id) FROM kept_elsewhere))",
    "SELECT * FROM {t} ORDER BY (SELECT max(id) FROM kept_elsewhere)", "SELECT * FROM {t} LIMIT (SELECT 1 FROM kept_elsewhere)",
    "SELECT id FROM {t} GROUP BY id HAVING id > (SELECT min(id) FROM kept_elsewhere)", "SELECT * FROM/**/kept_elsewhere",
    "SELECT * FROM {t} UNION ALL TABLE kept_elsewhere", "SELECT * FROM IDENTIFIER('kept_' || 'elsewhere')", "SELECT * FROM default.kept_elsewhere",
    "WITH kept AS (SELECT * FROM a), a AS (SELECT 1 AS x) SELECT * FROM kept", "SELECT * FROM (WITH kept_elsewhere AS (SELECT 1) SELECT 1), kept_elsewhere",
    "SELECT * FROM {t} PIVOT (max(id) FOR id IN (1, 2)) p, kept_elsewhere", "SELECT transform(array(1), x -> (SELECT max(id) FROM kept_elsewhere))",
    "SELECT * FROM VALUES ((SELECT max(id) FROM kept_elsewhere))", "SELECT * FROM explode(array((SELECT max(id) FROM kept_elsewhere)))",
    "SELECT * FROM range((SELECT max(id) FROM kept_elsewhere))", "SELECT * FROM {t} LATERAL VIEW explode(array((SELECT max(id) FROM kept_elsewhere))) v",
    "SELECT * FROM read_files('/etc/hosts')", "SELECT input_file_name() FROM {t}", "SELECT `reflect`('java.lang.Math', 'abs', -1)",
    "SELECT session.f(1)", "SELECT own_function(id) FROM {t}", "SELECT * FROM sql_keywords()", "SELECT * FROM {u}", "SELECT * FROM {t!r}",
    "SELECT * FROM kept_elsewhere VERSION AS OF 1", "SELECT TRANSFORM (id) USING 'cat' AS x FROM {t}"])
def test_refused_statements(spark, text):
    frame = spark.range(3)
    frame.createOrReplaceTempView("kept_elsewhere")
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(Exception):
        screening.guarded_sql(spark, text, {"t": frame})
    assert spark.conf.get("spark.sql.runSQLOnFiles", "true") == "true"


@pytest.mark.parametrize("text", [
    "SELECT * FROM (kept_elsewhere)", "SELECT * FROM {t} WHERE id IN (TABLE kept_elsewhere)", "SELECT * FROM {t}, LATERAL (SELECT * FROM kept_elsewhere)",
    "SELECT sum(id) OVER w FROM {t} WINDOW w AS (PARTITION BY (SELECT max(id) FROM kept_elsewhere))"])
def test_refusals_name_the_table(spark, text):
    assert sql_reads.foreign(spark, text, {"t": spark.range(1)}) == ["Unknown table: kept_elsewhere"]


@pytest.mark.parametrize("text,rows", [
    ("SELECT * FROM {t}", 3), ("WITH a AS (SELECT id FROM {t}), b (x) AS (SELECT id FROM a) SELECT * FROM a JOIN b ON a.id = b.x", 3),
    ("SELECT * FROM (SELECT id FROM {t} WHERE 'from nowhere' <> '') x", 3), ("SELECT * FROM VALUES (1), (2)", 2),
    ("SELECT a.id, b.m FROM {t} a CROSS JOIN LATERAL (SELECT max(x.id) AS m FROM {t} x WHERE x.id <= a.id) b", 3), ("SELECT * FROM ({t})", 3),
    ("SELECT id, sum(id) OVER w FROM {t} WINDOW w AS (ORDER BY id)", 3), ("SELECT * FROM {t} LATERAL VIEW explode(array(1, 2)) v AS x", 6),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r", 4), ("SELECT * FROM range(4)", 4),
    ("SELECT id FROM {t} WHERE id IN (SELECT id FROM {t}) EXCEPT SELECT 1", 2), ("SELECT count(*), id % 2 FROM {t} GROUP BY 2 HAVING count(*) > 0", 2),
    ("SELECT * FROM {t} TABLESAMPLE (100 PERCENT)", 3), ("SELECT * FROM (SELECT id, 1 AS one FROM {t}) UNPIVOT (v FOR k IN (id, one))", 6)])
def test_allowed_statements(spark, text, rows):
    assert len(screening.guarded_sql(spark, text, {"t": spark.range(3)}).collect()) == rows


def test_running_total_keeps_null_times_and_keys(spark):
    rows = [("a", "2024-01-01 10:00:00", 1), ("a", None, 2), (None, "2024-01-01 10:00:00", 4), (None, None, 8), ("a", "2024-01-02 09:00:00", 16)]
    df = spark.createDataFrame(rows, "k string, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.k, r.v): r.total for r in windows.running_total(df, "v", "t", [], "total", ["k"]).collect()}
    assert got == {("a", 2): 2, ("a", 1): 3, ("a", 16): 19, (None, 8): 8, (None, 4): 12}


def test_latencies_of_a_null_operation(spark):
    log = spark.createDataFrame([("latency.a", "latency", float(i)) for i in range(30)] + [(None, "latency", 5.0), (None, "latency", 7.5)],
                                "name string, type string, value double")
    got = {r.op: (r["count"], r.avg_ms, r.max_ms, r.min_ms, r.p95_ms) for r in metrics.latency_by_operation(log).collect()}
    assert got == {"a": (30, 14.5, 29.0, 0.0, 28.0), None: (2, 6.25, 7.5, 5.0, 7.5)}


FULL = {"description": "laptop", "gst_rate": "5", "taxable_value": "100", "cgst_amount": "1", "total_value": "118", "vendor": "V",
        "invoice_date": "2020-01-01"}


@pytest.mark.parametrize("absent", [[c] for c in FULL] + [list(FULL)])
def test_ledgers_without_a_role_column(spark, absent):
    columns = {k: v for k, v in FULL.items() if k not in absent} | {"source_table": "t", "other": "x"}
    ledger = spark.createDataFrame([tuple(columns.values())], list(columns)).withColumns(
        {c: F.col(c).cast("decimal(14,2)") for c in ("gst_rate", "taxable_value", "cgst_amount", "total_value") if c in columns})
    as_of = F.lit("2026-01-31").cast("date")
    kinds = {r.issue_type for r in audit.audit(ledger, ITEM_RATES, as_of, ["source_table"]).collect()}
    assert ("section_43b_h" in kinds) == ("invoice_date" not in absent)
    assert strategy.vendor_scores(ledger).count() == ("vendor" not in absent)
    assert strategy.top_items(ledger).count() >= 0 and strategy.cash_flow(ledger, ledger, as_of).count() == 3
    for parts in (strategy.strategy_report(ledger, ledger, as_of),):
        assert parts["notes"].count() >= 1
