"""Compare a registered query with its SQL twin in DuckDB (also a command line tool)."""

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else (
                tuple(v) if isinstance(v, (list, np.ndarray)) else v))
    return df


def rows(df):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return str(int(v))
        if isinstance(v, (float, np.floating)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message) of one query."""
    got_df = fn(spark, sf_dir)
    got_types = {f.name: f.dataType.simpleString() for f in got_df.schema}
    got = _normal(got_df.toPandas())
    rel = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = _normal(rel.fetchdf())
    if list(got.columns) != list(want.columns):
        return False, f"columns {list(got.columns)} vs {list(want.columns)}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [(c, got_types[c], want_types[c]) for c in got.columns if names.get(got_types[c], want_types[c]) != want_types[c]]
    if bad:
        return False, f"types {bad}"
    # Nullable integers arrive as floats in pandas on either side.
    for c in got.columns:
        if got_types[c] in ("bigint", "int"):
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    a, b = rows(got), rows(want)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"{len(diff)} of {len(a)} rows differ, e.g.\n   {diff[0][0]}\n   {diff[0][1]}\n   {diff[-1][0]}\n   {diff[-1][1]}"
    return True, f"{len(a)} rows"


def main():
    from __spark_entry__ import oracle_sql, queries
    from skyloom.session import local_session

    sf_dir = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    sql = oracle_sql()
    bad = []
    for name, fn in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sql:
                ok, msg = compare(spark, con, name, fn, sql[name], sf_dir)
            else:
                ok, msg = True, f"{len(fn(spark, sf_dir).toPandas())} rows (no SQL twin)"
        except Exception as e:  # report and go on with the other queries
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
