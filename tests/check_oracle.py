"""Compare bound queries with their DuckDB text: python tests/check_oracle.py [sf] [name part ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


CLOCK: dict[str, float] = {}


def kind(v):
    return "bool" if isinstance(v, bool) else type(v).__name__


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def compare(spark_df, sql: str, con) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_cols, got = ordered(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    CLOCK["spark"] = time.time()
    result = con.execute(sql)
    want_cols, want = ordered([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for g, w in zip(got, want):
        if g != w or [kind(v) for v in g] != [kind(v) for v in w]:
            bad = [
                (c, a, b) for c, a, b in zip(got_cols, g, w) if a != b or kind(a) != kind(b)
            ]
            return f"first difference {bad[:4]} in {g[:6]}"
    return None


def main() -> int:
    from bindings import load
    from riskloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = [a for a in sys.argv[2:] if a != "--sql"]  # --sql: only queries with a DuckDB text
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    spark = build_session(8)
    con = duck(sf_dir)
    failures = 0
    for name in queries:
        if parts and not any(p in name for p in parts):
            continue
        if "--sql" in sys.argv and name not in oracles:
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, oracles[name], con)
                spark_time = CLOCK["spark"] - start
                status = f"spark {spark_time:5.2f}s " + ("ok" if problem is None else f"DIFF {problem}")
            else:
                status = f"rows {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            text = str(error)
            status = f"ERROR {type(error).__name__}: {text[:600]}"
        failures += "DIFF" in status or "ERROR" in status
        print(f"{name:34s} {time.time() - start:6.2f}s {status}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
