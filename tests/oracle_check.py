"""Run registered queries against their DuckDB oracle, as the driver's gate does.

    python tests/oracle_check.py [sf_dir] [query ...]

Compares row count, column names and an order-insensitive hash of the values.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        v = round(v, 6)
        return repr(int(v)) if v.is_integer() else repr(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str, list[tuple]]:
    cols = sorted(df.columns)
    rows = sorted(tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    h = hashlib.sha256("\n".join("|".join(r) for r in rows).encode()).hexdigest()
    return len(rows), cols, h, rows


DUCK_TO_SPARK = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
                 "INTEGER": "int"}


def type_mismatches(spark_dtypes: dict, con, sql: str) -> list:
    d = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({sql})").fetchall()}
    return [(c, spark_dtypes.get(c), d.get(c)) for c in sorted(set(d) | set(spark_dtypes))
            if DUCK_TO_SPARK.get(d.get(c), d.get(c)) != spark_dtypes.get(c)]


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None, verbose=True):
    t0 = time.time()
    frame = fn(spark, sf_dir)
    sdf = frame.toPandas()
    t1 = time.time()
    if sql is None:
        if verbose:
            print(f"{name}: rows={len(sdf)} (no oracle) {t1 - t0:.1f}s")
        return True
    con = con or duck(sf_dir)
    ddf = con.execute(sql).fetchdf()
    a, b = digest(sdf), digest(ddf)
    types = type_mismatches(dict(frame.dtypes), con, sql)
    ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2] and not types
    if verbose:
        print(f"{name}: {'OK' if ok else 'MISMATCH'} spark={a[0]} duck={b[0]} {t1 - t0:.1f}s")
        if not ok:
            if a[1] != b[1]:
                print("  cols spark", a[1], "\n  cols duck ", b[1])
            if types:
                print("  types (col, spark, duck):", types)
            sa, sb = set(a[3]), set(b[3])
            for r in sorted(sa - sb)[:5]:
                print("  spark only:", r)
            for r in sorted(sb - sa)[:5]:
                print("  duck only: ", r)
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from newsgraph.session import get_session
    spark = get_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for n in names or list(qs):
        try:
            if not compare(spark, sf_dir, n, qs[n], sqls.get(n), con):
                bad.append(n)
        except Exception as e:  # report and go on
            print(f"{n}: ERROR {type(e).__name__}: {str(e)[:800]}")
            bad.append(n)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
