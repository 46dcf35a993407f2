"""Spark query vs DuckDB oracle: row count, column names/types, values.

Usable from pytest (``compare``) and as a script:
    python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=9):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def _kind(type_name: str) -> str:
    t = type_name.lower()
    if any(x in t for x in ("int", "long", "short", "byte")):
        return "int"
    if any(x in t for x in ("double", "float", "decimal", "real")):
        return "float"
    if "bool" in t:
        return "bool"
    if t.startswith("date"):
        return "date"
    if "timestamp" in t:
        return "timestamp"
    if "array" in t or t.endswith("[]") or "list" in t:
        return "array"
    if "string" in t or "varchar" in t:
        return "string"
    return t


def normalize_rows(cols, rows, digits=9):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    out.sort(key=repr)
    return out


def compare(spark, name, fn, sql, sf_dir, digits=6):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = duck(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        sk = {c: _kind(t) for c, t in zip(s_cols, s_types)}
        dk = {c: _kind(t) for c, t in zip(d_cols, d_types)}
        bad = {c: (sk[c], dk[c]) for c in sk if sk[c] != dk[c]}
        if bad:
            problems.append(f"types {bad}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a = normalize_rows(s_cols, s_rows, digits)
        b = normalize_rows(list(d_cols), d_rows, digits)
        if a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ e.g. {diffs}")
    res["status"] = "ok" if not problems else "FAIL"
    if problems:
        res["problems"] = problems
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from presslens.session import local_session
    spark = local_session(8)
    qs, sqls = E.queries(), E.oracle_sql()
    n_ok = n_fail = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "ERROR", "problems": [repr(e)[:600]]}
        n_ok += r["status"] in ("ok", "rows-only")
        n_fail += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"ok={n_ok} fail={n_fail}")


if __name__ == "__main__":
    main(sys.argv)
