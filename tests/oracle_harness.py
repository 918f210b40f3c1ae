"""Side-by-side check of a registered Spark query against its DuckDB SQL.

Mirrors the driver's correctness gate: same column names, same row count,
same multiset of rows (floats rounded). Usable from pytest and as a script:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def compare(spark, con, name: str, fn, sql: str, sf_dir: str, digits: int = 6) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_types = {d[0]: str(d[1]) for d in res.description}
    d_rows = res.fetchall()
    t2 = time.time()
    out = {"name": name, "spark_sec": round(t1 - t0, 2), "duck_sec": round(t2 - t1, 2)}
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    out["rows"] = (len(s_rows), len(d_rows))
    type_diff = {c: (s_types[c], d_types.get(c)) for c in s_cols if SPARK_TO_DUCK.get(s_types[c], s_types[c]) != d_types.get(c)}
    out["type_diff"] = type_diff
    if not out["cols_match"]:
        out["ok"] = False
        out["detail"] = f"spark cols {s_cols} vs duck {d_cols}"
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i], digits) for i in si) for r in s_rows)
    dc = Counter(tuple(_norm(r[i], digits) for i in di) for r in d_rows)
    out["ok"] = sc == dc
    if not out["ok"]:
        only_s = list((sc - dc).elements())[:3]
        only_d = list((dc - sc).elements())[:3]
        out["detail"] = {"cols": order, "only_spark": only_s, "only_duck": only_d, "n_diff": sum((sc - dc).values())}
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from relmine.session import get_session

    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    con = duck_connect(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print({"name": name, "oracle": None, "rows": df.count()})
            continue
        r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        bad += not r["ok"]
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv)
