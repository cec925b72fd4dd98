"""Compare a registered query with its SQL on DuckDB, as bags of rows."""
from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    return x if isinstance(x, (int, str)) else str(x)


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, build, sql, folder):
    """(ok, message)."""
    df = build(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _bag(df.columns, rows), _bag(names, want)
    if a == b:
        types = {type(v) for r in rows[:50] for v in r}
        return True, f"{len(rows)} rows"
    extra, lack = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{len(rows)} vs {len(want)} rows; columns {sorted(names)}\n   spark only {extra}\n   sql only   {lack}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from civisight.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, build, oracle.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failures:", bad)
