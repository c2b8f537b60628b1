"""Side-by-side check of a registered query against its DuckDB oracle (small scale factors).

Used by the tests and by ``python -m qlift.plans.check <key>...``.  Rows are compared as
multisets after normalising floats (6 decimals), so row order never matters.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys

from .registry import load_all

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    if isinstance(v, bool):
        return bool(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, key: str, sf_dir: str, con=None, verbose: bool = False) -> dict:
    specs = load_all()
    spec = specs[key]
    df = spec.fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(_norm(v) for v in r) for r in df.collect()]
    res = {"key": key, "spark_rows": len(s_rows)}
    sql = spec.oracle()
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck_connect(sf_dir)
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(_norm(v) for v in r) for r in cur.fetchall()]
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: spark={s_cols} duck={d_cols}"
        return res
    perm = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in perm) for r in d_rows]
    s_sorted, d_sorted = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    if s_sorted == d_sorted:
        res["status"] = "match"
    else:
        res["status"] = "values differ"
        sset, dset = set(s_sorted), set(d_sorted)
        res["only_spark"] = [r for r in s_sorted if r not in dset][:3]
        res["only_duck"] = [r for r in d_sorted if r not in sset][:3]
        res["columns"] = s_cols
    return res


def main(argv: list[str]) -> int:
    from ..session import build_session

    sf = "/root/testdata/sf0.01"
    keys = []
    for a in argv:
        if a.startswith("--sf="):
            sf = a.split("=", 1)[1]
        else:
            keys.append(a)
    spark = build_session()
    specs = load_all()
    keys = keys or list(specs)
    keys = [k for k in specs if any(k.startswith(p) for p in keys)]
    con = duck_connect(sf)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
