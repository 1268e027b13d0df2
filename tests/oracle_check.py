"""Run registered queries beside their SQL twins: python tests/oracle_check.py [names...] [--sf DIR]."""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        v = round(v, 6)
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows {len(got)} spark {t1 - t0:.1f}s (no sql)"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    c1, r1 = rows(df.columns, got)
    c2, r2 = rows(want_cols, want)
    msg = f"{name}: rows {len(got)}/{len(want)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    dt = dict(df.dtypes)
    odd = [(c, dt.get(c), t) for c, t in zip(want_cols, types) if t.startswith(("HUGEINT", "DECIMAL")) or (dt.get(c, "").startswith("decimal"))]
    if odd:
        msg += f" TYPES {odd}"
    if c1 != c2:
        return False, msg + f" COLUMNS {c1} vs {c2}"
    if r1 != r2:
        s1, s2 = set(r1), set(r2)
        return False, msg + f" VALUES cols {c1}\n  only spark {list(s1 - s2)[:4]}\n  only sql {list(s2 - s1)[:4]} ({len(s1 - s2)}/{len(s2 - s1)})"
    return True, msg + " ok"


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    import __spark_entry__ as entry
    from inkspan.session import build_session

    spark = build_session(master="local[8]", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, n, qs[n], sqls.get(n), sf)
        except Exception as e:  # report and go on
            ok, msg = False, f"{n}: ERROR {type(e).__name__} {str(e)[:900]}"
        bad += not ok
        print(("" if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
