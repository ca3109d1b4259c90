"""Run registered queries against their check SQL: check.py [sf] [name ...]"""

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from honeyframe import catalog  # noqa: E402
from honeyframe.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def oracle(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    spent = f"(spark {time.time() - t0:.2f}s) "
    if name not in catalog.ORACLES:
        return f"{spent}rows {len(got)}", True
    cols, want = oracle(con, catalog.ORACLES[name])
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", False
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"{spent}ok {len(a)}", True
    sa, sb = set(a), set(b)
    return (
        f"MISMATCH {len(a)} vs {len(b)} cols {sorted(cols)}\n   spark only {sorted(sa - sb)[:3]}"
        f"\n   duck only {sorted(sb - sa)[:3]}",
        False,
    )


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0] == "0" else "0.001"
    mods = [a[1:] for a in args if a.startswith("@")]
    names = [a for a in args if not a.startswith("@")]
    for m in mods:
        before = set(catalog.QUERIES)
        importlib.import_module(f"honeyframe.catalog.{m}")
        names += [n for n, f in catalog.QUERIES.items() if f.__module__.endswith("." + m)]
    if not mods:
        catalog.load()
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    bad = 0
    for n in names or list(catalog.QUERIES):
        t = time.time()
        try:
            msg, ok = compare(spark, con, sf_dir, n)
        except Exception as e:  # noqa: BLE001 - report and go on
            msg, ok = f"ERROR {type(e).__name__}: {str(e)[:900]}", False
        bad += not ok
        print(f"{n:24s} {time.time() - t:6.2f}s {'' if ok else '!! '}{msg}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
