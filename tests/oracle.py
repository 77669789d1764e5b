"""Run registered queries and their SQL side by side: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(r) for r in rows.itertuples(index=False)), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype != want[c].dtype}
    if kinds:
        return f"types differ: {kinds}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(canonical(got), canonical(want)):
        if repr(a) != repr(b):
            return f"{a} and {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from labelvec.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            result = "rows only" if sql is None else difference(got, con.execute(sql).df())
        except Exception as error:  # report and go on with the next query
            got, took, result = [], time.time() - start, f"{type(error).__name__}: {error}"[:1500]
        bad += result not in (None, "rows only")
        print(f"{name:24s} {took:6.2f}s {len(got):7d} rows  {result or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
