"""Runs registered queries next to their SQL and compares results. Usage: python tests/oracle.py [sf] [names...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
         "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else (0.0 if x == 0 else x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def key(row):
    return tuple((x is not None, str(type(x).__name__), f"{x:.6g}" if isinstance(x, float) else str(x)) for x in row)


def compare(spark_rows, spark_schema, oracle_rows, oracle_schema):
    """Empty list when equal; floats must agree exactly, 'close' marks those that only agree to 1e-9."""
    problems = []
    s_cols, o_cols = [c for c, _ in spark_schema], [c for c, _ in oracle_schema]
    if sorted(s_cols) != sorted(o_cols):
        return [f"columns differ: spark only {sorted(set(s_cols) - set(o_cols))}, sql only {sorted(set(o_cols) - set(s_cols))}"]
    o_types = dict(oracle_schema)
    for c, ty in spark_schema:
        if TYPES.get(ty, ty) != o_types[c]:
            problems.append(f"type of {c}: spark {ty}, sql {o_types[c]}")
    if len(spark_rows) != len(oracle_rows):
        problems.append(f"rows: spark {len(spark_rows)}, sql {len(oracle_rows)}")
        return problems
    names = sorted(s_cols)
    si, oi = [s_cols.index(c) for c in names], [o_cols.index(c) for c in names]
    a = [tuple(norm(r[i]) for i in si) for r in spark_rows]
    b = [tuple(norm(r[i]) for i in oi) for r in oracle_rows]
    if sorted(map(repr, a)) == sorted(map(repr, b)):
        return problems
    a.sort(key=key), b.sort(key=key)
    close, bad = 0, []
    for x, y in zip(a, b):
        for c, p, q in zip(names, x, y):
            if p == q:
                continue
            if isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9):
                close += 1
            else:
                bad.append((c, p, q, dict(zip(names, x))))
    if bad:
        problems.append(f"{len(bad)} cells differ, e.g. {bad[:2]}")
    if close:
        problems.append(f"close: {close} cells differ within 1e-9")
    return problems


def check(spark, con, sf_dir, name):
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return took, len(rows), None
    cur = con.execute(sql)
    schema = [(d[0], str(d[1])) for d in cur.description]
    return took, len(rows), compare([tuple(r) for r in rows], df.dtypes, cur.fetchall(), schema)


def main(argv):
    from flowlytics.session import local_session

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            took, n, problems = check(spark, con, sf_dir, name)
        except Exception as e:
            text = str(e).strip()
            took, n, problems = 0, 0, [f"{type(e).__name__}: {text[:600]}"]
        state = "rows only" if problems is None else ("ok" if not problems else "FAIL")
        failed += state == "FAIL"
        print(f"{state:9s} {name:28s} {n:7d} rows {took:6.2f} s {problems or ''}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
