"""Run registered queries against their SQL twins in DuckDB and compare the values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from gridloom.tables import NAMES

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def canon(rows, order):
    def one(v):
        if isinstance(v, float):
            if math.isnan(v):
                return "NaN"
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cols = df.columns
    if sql is None:
        return "rows" if rows else "EMPTY", f"{len(rows)} rows", t1 - t0
    rel = con.sql(sql)
    ocols, otypes = rel.columns, [str(t) for t in rel.types]
    orows = rel.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(ocols):
        return "FAIL", f"columns {sorted(cols)} != {sorted(ocols)}", t1 - t0
    names = sorted(cols)
    st = dict(df.dtypes)
    ot = dict(zip(ocols, otypes))
    bad = [(c, st[c], ot[c]) for c in names if TYPES.get(st[c], st[c]) != ot[c]]
    if bad:
        return "FAIL", f"types {bad}", t1 - t0
    a = canon(rows, [cols.index(c) for c in names])
    b = canon(orows, [ocols.index(c) for c in names])
    if len(a) != len(b):
        return "FAIL", f"rows {len(a)} != {len(b)} first {a[:2]} | {b[:2]}", t1 - t0
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return "FAIL", f"{len(diff)} of {len(a)} differ; cols {names}; {diff[0]}", t1 - t0
    return ("ok" if a else "EMPTY"), f"{len(a)} rows (sql {t2 - t1:.1f}s)", t1 - t0


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from gridloom.session import local_session

    sf = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    tally = {}
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, msg, sec = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            status, msg, sec = "ERROR", str(e)[:700], 0.0
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:6s} {name:34s} {sec:6.1f}s {msg}", flush=True)
    print(tally)


if __name__ == "__main__":
    main(sys.argv[1:])
