"""Compare registered queries with their SQL: ``python tests/check.py sf_dir [name …]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    """A comparable form that keeps types apart: a whole float is not an int."""
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return f"f{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"d{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return f"s{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = rows_of(df.columns, got_rows), rows_of(names, want_rows)
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"


def main():
    from velum.plans import ORACLES, QUERIES
    from velum.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                n = "ok" if problem is None else problem
            else:
                n = f"rows only: {len(df.collect())}"
                problem = None
        except Exception as e:
            problem = n = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s  {n}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
