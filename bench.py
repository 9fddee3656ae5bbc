"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 3; the median counts)
BENCH_QUERIES comma-separated names instead of the headline list, or "all"
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from khata.plans import registry  # noqa: E402
from khata.session import build_session  # noqa: E402

HEADLINE = [
    "j1_goods_rate", "j5_item_rate", "v1_gstin", "v5_tax_total", "v8_payment_limit", "v9_transaction_findings",
    "b1_rate_check", "b4_full_audit", "a15_audit_totals", "a11_vendor_metrics", "b6_cash_flow", "b12_prioritized",
    "q1_guarded_select", "a3_null_counts", "a8_family_top", "a9_monthly_trend", "a17_latency_by_operation",
    "w6_running_balance", "m2_table_statistics", "m10_table_choice", "s16_load_plan", "s3_messy_csv",
    "c1_question_class", "c3_intent", "c5_threat_levels", "c7_sql_screen", "k1_chunks", "k4_nearest", "u5_first_copies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry.load_all()
    names = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if names == "all" else [n for n in names.split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")

    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name:32s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None, "lineitem_rows": rows,
        "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
