"""Run registered queries and compare them with their SQL, as multisets of rows.

    python tests/compare.py [--sf 0.01] [names...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import tempfile
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
try:
    import duckdb
except ImportError:
    sys.path.append("/opt/oracle")
    import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def oracle(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def difference(spark, con, name, sf_dir) -> tuple[str | None, int]:
    """What differs (None if nothing) and the number of rows."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = multiset(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, sum(got.values())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = multiset(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", sum(got.values())
    if got == want:
        return None, sum(got.values())
    extra, missing = got - want, want - got
    return (f"{sum(got.values())} rows, expected {sum(want.values())}; columns {sorted(columns)}; "
            f"extra {list(extra)[:3]}; missing {list(missing)[:3]}"), sum(got.values())


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from ferryline.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    wrong = 0
    for name in args.names or list(entry.queries()):
        began = time.time()
        try:
            problem, rows = difference(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        wrong += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{wrong} of {len(args.names or entry.queries())} differ")
    return wrong


if __name__ == "__main__":
    sys.exit(main())
