"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

usage: python tests/oracle_check.py [data folder] [query ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    secs = time.time() - t0
    if sql is None:
        return "rows-only", len(got), secs, None
    cur = con.execute(sql)
    want = cur.fetchall()
    wc = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(wc, want)
    if gc != wc:
        return "COLUMNS", len(got), secs, (gc, wc)
    if g != w:
        gs, ws = set(g), set(w)
        return "DIFF", len(got), secs, (len(g), len(w), list(gs - ws)[:3], list(ws - gs)[:3])
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = {c: (spark_types[c], types[c]) for c in gc if not same_type(spark_types[c], types[c])}
    return ("TYPES" if odd else "ok"), len(got), secs, odd or None


def same_type(s, d):
    return {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(s) == d


def main(argv):
    from tidemark.plans.oracle import ORACLE
    from tidemark.plans.registry import QUERIES
    from tidemark.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = build_session("check", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in wanted:
        try:
            state, n, secs, info = compare(spark, con, name, QUERIES[name][1], ORACLE.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            state, n, secs, info = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += state not in ("ok", "rows-only")
        print(f"{state:9} {name:28} rows={n:<7} {secs:6.2f}s {info if info else ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
