"""Run queries beside their SQL in DuckDB and compare rows: python tests/compare.py SF NAME..."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/**/*.parquet'}')")
    return c


def compare(spark, query, sql: str, folder: str) -> str:
    """'' if both give the same rows, else what differs."""
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    got = views(folder).execute(sql)
    cols = [x[0] for x in got.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    if ours == theirs:
        return ""
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only Spark {sum(a.values())}: {list(a)[:3]}; only SQL {sum(b.values())}: {list(b)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e
    from crawlloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    q, o = e.queries(), e.oracle_sql()
    for n in names or sorted(q):
        t = time.time()
        try:
            if n in o:
                said = compare(spark, q[n], o[n], f"/root/testdata/{sf}") or "same"
            else:
                said = f"no SQL; {q[n](spark, f'/root/testdata/{sf}').count()} rows"
        except Exception as x:
            said = f"ERROR {str(x)[:1500]}"
        print(f"{n}: {said} ({time.time() - t:.1f} s)", flush=True)
