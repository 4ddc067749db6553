"""Compare registered queries with their SQL: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of columns in name order; missing values are None."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(row) for row in frame.itertuples(index=False)), key=repr)


def plain(rows: list[tuple]) -> list[tuple]:
    return [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in rows]


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    mine = query(spark, sf_dir).toPandas()
    middle = time.time()
    theirs = con.execute(sql).df()
    end = time.time()
    timing = f"spark {middle - start:.1f}s duckdb {end - middle:.1f}s rows {len(mine)}"
    if sorted(mine.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(mine.columns)} / {sorted(theirs.columns)} {timing}"
    a, b = plain(canonical(mine)), plain(canonical(theirs))
    if a == b:
        return True, timing
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"{len(a)} / {len(b)} rows differ, first {diff} {timing}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from hybridlake.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, con = local_session(8), connect(sf_dir)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            if name in oracle:
                ok, note = compare(spark, con, name, query, oracle[name], sf_dir)
            else:
                start = time.time()
                ok, note = True, f"rows only: {query(spark, sf_dir).count()} {time.time() - start:.1f}s"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, str(error)[:1500]
        print("ok  " if ok else "FAIL", name, note[:1500], flush=True)
