"""Compare registered queries with their SQL. ``python -m tests.oracle [names...]`` prints one line per query."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

#: Queries that SQL can't express, and the test that compares each with a plain version, or its accuracy.
WITHOUT_SQL = {
    "drop_overlap": "test_frames.py", "drop_overlap_vertical": "test_frames.py",
    "op2_secret_scan": "llm/test_brute.py", "op5_quality": "llm/test_brute.py", "op8_pieces": "llm/test_brute.py", "op9_licences": "llm/test_brute.py",
    "op10_languages": "llm/test_brute.py", "op11_toxicity": "llm/test_toxicity.py", "op13_alignment": "llm/test_alignment.py", "pipeline": "llm/test_brute.py",
}

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return names, sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) else (True, "n", v) for v in r))


def exact(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] + 0.0 if isinstance(row[i], float) else row[i] for i in order]) for row in rows)


def compare(spark, name, query, sql, sf_dir: str = SF, con=None):
    """Return (ok, message)."""
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return name in WITHOUT_SQL, f"{len(rows)} rows, no SQL, compared in {WITHOUT_SQL.get(name, 'no test')}, {took:.1f}s"
    relation = (con or duck(sf_dir)).execute(sql)
    expected_columns = [d[0] for d in relation.description]
    expected_rows = relation.fetchall()
    got_names, got = table(df.columns, rows)
    exp_names, exp = table(expected_columns, expected_rows)
    if got_names != exp_names:
        return False, f"columns {got_names} != {exp_names}"
    if len(got) != len(exp):
        return False, f"rows {len(got)} != {len(exp)}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ {got_names}; got {bad[0][0]} expected {bad[0][1]}"
    kinds = {
        n: (type(g), type(e))
        for n, *pairs in zip(got_names, *[list(zip(g, e)) for g, e in zip(got[:50], exp[:50])])
        for g, e in pairs
        if g is not None and type(g) is not type(e)
    }
    inexact = "" if exact(df.columns, rows) == exact(expected_columns, expected_rows) else "INEXACT "
    return not kinds, f"{len(got)} rows, {took:.1f}s {inexact}{kinds or ''}"


def main(names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from metrum import build_session

    spark = build_session("oracle", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duck()
    failed = 0
    chosen = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for name in chosen:
        try:
            ok, message = compare(spark, name, queries[name], oracle.get(name), con=con)
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + message, flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} fine")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
