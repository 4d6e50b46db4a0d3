"""Compare registered queries with their SQL text: python -m tests.oracle_check [scale] [name ...]."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TIMES: dict[str, float] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) >= 1e9 else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def kind(v):
    return "num" if isinstance(v, (float, decimal.Decimal)) else type(v).__name__


def compare(q, spark, path, con):
    df = q.run(spark, path)
    cols = sorted(df.columns)
    t0 = time.time()
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    TIMES[q.name] = time.time() - t0
    if q.sql is None:
        return (None if rows else "no rows"), len(rows)
    dt = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    loose = [c for c, t in dt.items() if t in ("double", "float") and c not in q.doubles]
    if loose:
        return f"doubles not rounded in SQL: {loose}", len(rows)
    cur = con.execute(q.oracle())
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", len(rows)
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    kinds = lambda rs: {c: {kind(r[i]) for r in rs if r[i] is not None} for i, c in enumerate(cols)}
    ka, kb = kinds(rows), kinds(want)
    bad = {c: (ka[c], kb[c]) for c in cols if ka[c] != kb[c]}
    a = sorted(tuple(canon(x) for x in r) for r in rows)
    b = sorted(tuple(canon(x) for x in r) for r in want)
    if a != b:
        sa, sb = set(a) - set(b), set(b) - set(a)
        return f"rows {len(a)} vs {len(b)}; spark-only {list(sa)[:2]} sql-only {list(sb)[:2]} cols {cols}", len(rows)
    if bad:
        return f"types {bad}", len(rows)
    return (None if rows else "no rows"), len(rows)


def main():
    from vigitab.plans.load import REGISTRY
    from vigitab.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pick = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(path)
    fails = 0
    for name, q in REGISTRY.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        t0 = time.time()
        try:
            err, n = compare(q, spark, path, con)
        except Exception as e:  # report and go on with the next query
            err, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        fails += err is not None
        print(f"{'ok ' if err is None else 'BAD'} {name} rows={n} {TIMES.get(name, 0):.1f}s of {time.time() - t0:.1f}s {err or ''}", flush=True)
    print("fails", fails)


if __name__ == "__main__":
    main()
