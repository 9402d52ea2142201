"""Runs a query and its SQL side by side and compares rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else int(x) if isinstance(x, bool) else float(x) if type(x).__name__ == "Decimal" else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str):
    """(equal, what differs)"""
    df = query(spark, sf_dir)
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = views(sf_dir).sql(sql)
    want_c, want = rows_of(rel.columns, rel.fetchall())
    if got_c != want_c:
        return False, f"columns {got_c} != {want_c}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; first odd {[x for x in got if x not in set(want)][:2]} {[x for x in want if x not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b))]
    return not bad, f"{len(bad)} of {len(got)} rows differ: {bad[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tests.conftest import session

    spark = session()
    queries, sql = e.queries(), e.oracle_sql()
    sf = f"/root/testdata/{sys.argv[1]}"
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name in sql:
                ok, why = compare(spark, sf, queries[name], sql[name])
                print(name, "ok" if ok else "DIFFERS", "" if ok else why[:1500], f"{time.time() - began:.1f} s", flush=True)
            else:
                print(name, "no sql,", queries[name](spark, sf).count(), "rows", f"{time.time() - began:.1f} s", flush=True)
        except Exception as x:
            print(name, "ERROR", f"{type(x).__name__}: {x}"[:1800], flush=True)
