"""Run registered queries next to their SQL on one data folder.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import pathlib
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return round(value + 0.0, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{name}: rows {sum(got.values())} (no SQL) {took:.2f}s"
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        return True, f"{name}: ok {sum(got.values())} rows {took:.2f}s"
    extra, lacking = got - want, want - got
    return False, (
        f"{name}: MISMATCH {sum(got.values())} vs {sum(want.values())}; columns {sorted(columns)}\n"
        f"   spark only ({sum(extra.values())}): {list(extra)[:3]}\n   sql only ({sum(lacking.values())}): {list(lacking)[:3]}"
    )


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from almagest import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    all_queries, sql = queries(), oracle_sql()
    names = sys.argv[2:] or list(all_queries)
    bad = 0
    for name in names:
        try:
            ok, text = compare(spark, con, folder, name, all_queries[name], sql.get(name))
        except Exception as error:  # noqa: BLE001 - a report over all queries
            ok, text = False, f"{name}: ERROR {str(error)[:1500]}"
        bad += not ok
        print(text, flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
