"""Small frames for the corpus operators, and a run of registered queries against their SQL."""

import os
import sys
import time

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def frame(spark, texts, langs=None, sources=None, ids=None):
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def saved(spark, df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def against_sql(spark, path, name):
    """None if the query's rows equal its SQL's rows, else what differs."""
    import duckdb

    from vigitab.llm.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, path)
    cols = sorted(df.columns)
    t0 = time.time()
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    took = time.time() - t0
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        at = f"{path}/{table}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()))
    if got == want:
        return None
    return f"{name}: {len(got)} vs {len(want)} rows in {took:.1f} s; {sorted(set(got) - set(want))[:3]} {sorted(set(want) - set(got))[:3]}"


def main():
    from vigitab.session import local_session

    spark = local_session(8, 8, "llm")
    from vigitab.llm.queries import ORACLES, QUERIES

    for name in sys.argv[2:] or QUERIES:
        t0 = time.time()
        if name in ORACLES:
            print(name, against_sql(spark, sys.argv[1], name) or "ok", f"{time.time() - t0:.1f} s", flush=True)
        else:
            df = QUERIES[name](spark, sys.argv[1])
            print(name, df.count(), f"{time.time() - t0:.1f} s", flush=True)
            df.show(4, 60)


if __name__ == "__main__":
    main()
