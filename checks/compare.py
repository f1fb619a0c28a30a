"""Run registered queries in Spark and DuckDB side by side and compare values."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from rosterlake.session import local_session

from .fixtures import TABLES
from .oracles import ORACLES
from .queries import QUERIES
from .scratch import with_scratch


def duckdb_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def differences(spark, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short description of the first differences."""
    df = QUERIES[name](spark, sf_dir)
    names, rows = duckdb_rows(sf_dir, ORACLES[name])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    order = sorted(names)
    ours = Counter(tuple(r[c] for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(r[i] for i in at) for r in rows)
    if ours == theirs:
        return None
    left, right = list((ours - theirs).items()), list((theirs - ours).items())
    return f"{sum(ours.values())} rows vs {sum(theirs.values())}; only Spark {left[:2]}; only DuckDB {right[:2]}"


def main() -> int:
    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = with_scratch(local_session(8))
    bad = 0
    for name in only or QUERIES:
        if name not in ORACLES:
            print(f"rows-only {name}")
            continue
        start = time.time()
        try:
            found = differences(spark, sf_dir, name)
        except Exception as e:  # a broken query is a finding like any other
            found = f"{type(e).__name__}: {str(e)[:500]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {(found or '')[:1500]}", flush=True)
    print(f"{bad} differences")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
