"""Run registered queries on Spark and DuckDB over one folder and compare them.

python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from khata.plans import registry  # noqa: E402
from khata.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(v) -> str:
    import datetime
    import decimal
    import numbers
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return "bool"
    if isinstance(v, numbers.Integral):
        return "int"
    if isinstance(v, numbers.Real) and not isinstance(v, decimal.Decimal):
        return "float"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return "date"
    return type(v).__name__


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple("\0" if r[i] is None else f"{kind(r[i])}:{r[i]!r}" for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = registry.QUERIES[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE:
        return f"rows only: {len(got[1])}"
    cur = con.execute(registry.ORACLE[name])
    want = normal([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS differ: {got[0]} / {want[0]}"
    if got[1] != want[1]:
        only_got = [r for r in got[1] if r not in set(want[1])][:2]
        only_want = [r for r in want[1] if r not in set(got[1])][:2]
        return f"ROWS differ: {len(got[1])} / {len(want[1])}\n   spark  {only_got}\n   duckdb {only_want}\n   {got[0]}"
    return f"ok {len(got[1])}" + ("  (EMPTY)" if not got[1] else "")


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    registry.load_all()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in registry.QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name)
        except Exception as e:
            result = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        bad += not (result.startswith("ok") or result.startswith("rows only"))
        print(f"{name:34s} {time.time() - start:6.2f}s {result}", flush=True)
    spark.stop()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
