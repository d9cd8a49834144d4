"""Run registered queries beside their SQL in DuckDB and compare value by value.

Usage: python tests/check_catalog.py [sf_dir] [name-substring ...]
"""

import logging
import math
import os
import sys
import time
import traceback
from concurrent.futures import ThreadPoolExecutor

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def canon(v):
    if v is None:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


KIND = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT"}


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    got = df.collect()
    if sql is None:
        return f"rows-only {len(got)}"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    notes = ""
    for c, t in df.dtypes:
        if KIND.get(t) != kinds[c]:
            notes += f" TYPE {c}: {t} vs {kinds[c]};"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"ok {len(a)}" + notes
    sa, sb = set(a), set(b)
    return (f"MISMATCH rows {len(a)} vs {len(b)}{notes}\n   cols {sorted(cols)}\n"
            f"   spark-only {sorted(sa - sb, key=repr)[:3]}\n   duck-only {sorted(sb - sa, key=repr)[:3]}"
            f"\n   n_diff {len(sa - sb)}")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    import __spark_entry__ as entry
    from ropeway.session import build_session

    spark = build_session("check", "local[8]")
    spark.sparkContext.setLogLevel(os.environ.get("LOG", "OFF"))
    logging.disable(logging.CRITICAL)
    if os.environ.get("ROWS_PER_TASK"):
        spark.conf.set("ropeway.rowsPerTask", os.environ["ROWS_PER_TASK"])
    con = connect(sf)
    sqls = entry.oracle_sql()
    bad = []

    def one(item):
        name, fn = item
        t = time.time()
        try:
            out = compare(spark, con.cursor(), name, fn, sqls.get(name), sf)
        except Exception as e:
            out = "ERROR " + str(e)[:700]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not out.startswith(("ok", "rows-only")) or "TYPE" in out:
            bad.append(name)
        print(f"{name:36s} {time.time() - t:6.2f}s {out}", flush=True)

    chosen = [(n, f) for n, f in entry.queries().items() if not wanted or any(w in n for w in wanted)]
    with ThreadPoolExecutor(int(os.environ.get("THREADS", "1"))) as pool:
        list(pool.map(one, chosen))
    print("BAD", bad)


if __name__ == "__main__":
    main()
