"""Compares queries() with oracle_sql() on one folder of driver tables."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

GOOD = {"BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN", "DATE", "TIMESTAMP", "INTEGER"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    from leadloom.plans.driver_tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}" if v != 0 else "0.000000"
    return str(v)


def compare(spark, con, folder, name, query, sql) -> list[str]:
    df = query(spark, folder)
    rows = df.collect()
    names = sorted(df.columns)
    mine = sorted(tuple(_cell(r[c]) for c in names) for r in rows)
    out = []
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "decimal")]
    if nested:
        out.append(f"{name}: nested columns {nested}")
    if sql is None:
        return out + ([f"{name}: no rows"] if not rows else [])
    res = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in res.description}
    theirs_names = sorted(desc)
    if theirs_names != names:
        return out + [f"{name}: columns {names} != {theirs_names}"]
    bad = {k: v for k, v in desc.items() if v not in GOOD}
    if bad:
        out.append(f"{name}: oracle types {bad}")
    spark_types = {f.name: f.dataType.typeName() for f in df.schema}
    kinds = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    odd = {k: (spark_types[k], desc[k]) for k in names if kinds.get(spark_types[k]) != desc[k]}
    if odd:
        out.append(f"{name}: types differ {odd}")
    order = [list(desc).index(c) for c in names]
    theirs = sorted(tuple(_cell(r[i]) for i in order) for r in res.fetchall())
    if mine != theirs:
        a, b = set(mine), set(theirs)
        out.append(f"{name}: rows {len(mine)} vs {len(theirs)}; columns {names}\n   only spark {sorted(a - b)[:3]}\n   only oracle {sorted(b - a)[:3]}")
    if not mine:
        out.append(f"{name}: no rows")
    return out


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.perf_counter()
        try:
            problems = compare(spark, con, folder, name, query, oracle.get(name))
        except Exception as error:  # noqa: BLE001
            problems = [f"{name}: {type(error).__name__} {str(error)[:900]}"]
        took = time.perf_counter() - start
        print(f"{'FAIL' if problems else 'ok  '} {name} {took:.1f}s{'' if name in oracle else ' (rows only)'}", flush=True)
        for p in problems:
            print("  ", p, flush=True)
        failed += bool(problems)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
