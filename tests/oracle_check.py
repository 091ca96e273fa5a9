"""Compare every registered Spark query with its DuckDB oracle on one scale factor.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH / ERROR, with the reason.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT"}


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in BASE:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def norm(v, strict=STRICT):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v if strict else round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if hasattr(v, "tolist"):
        return tuple(v.tolist())
    if isinstance(v, list):
        return tuple(v)
    return v


def key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def compare(spark, con, name, fn, sql, sf_dir, strict=STRICT):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_schema = [(f.name, f.dataType.simpleString()) for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return "ROWS", f"{len(s_rows)} rows ({t1 - t0:.1f}s)"
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    s_names = sorted(n for n, _ in s_schema)
    if s_names != sorted(d_cols):
        return "MISMATCH", f"columns spark={sorted(s_names)} duck={sorted(d_cols)}"
    s_types = dict(s_schema)
    bad_t = [(c, s_types[c], dt) for c, dt in zip(d_cols, d_types) if TYPE_MAP.get(s_types[c], s_types[c]) != dt]
    if bad_t:
        return "MISMATCH", f"types {bad_t}"
    order = [c for c in d_cols]
    s_idx = [[n for n, _ in s_schema].index(c) for c in order]
    s_norm = sorted((tuple(norm(r[i], strict) for i in s_idx) for r in s_rows), key=key)
    d_norm = sorted((tuple(norm(x, strict) for x in r) for r in d_rows), key=key)
    if len(s_norm) != len(d_norm):
        return "MISMATCH", f"rows spark={len(s_norm)} duck={len(d_norm)}"
    for a, b in zip(s_norm, d_norm):
        if a != b:
            return "MISMATCH", f"first diff spark={a} duck={b}"
    return "OK", f"{len(s_norm)} rows ({t1 - t0:.1f}s)"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    only = set(argv[2:])
    import __spark_entry__ as E
    from bankspark.plans.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            status, msg = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            status, msg = "ERROR", f"{type(e).__name__}: {str(e)[:400]}"
        if status not in ("OK", "ROWS"):
            bad += 1
        print(f"{status:9s} {name}: {msg}", flush=True)
    print(f"{bad} problems / {len([n for n in qs if not only or n in only])} queries")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
