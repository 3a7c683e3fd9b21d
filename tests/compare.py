"""Compare registered queries with their SQL on one scale folder.

Usage: python tests/compare.py [folder] [key ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows(table: pa.Table):
    names = sorted(table.column_names)
    data = table.select(names).to_pylist()
    return names, sorted((repr([plain(r[n]) for n in names]) for r in data))


def kinds(table: pa.Table):
    return {f.name: str(f.type).replace("large_", "").replace("string_view", "string") for f in table.schema}


def compare(spark, con, fn, sql, folder):
    got = fn(spark, folder).toArrow()
    want = con.sql(sql).to_arrow_table()
    gn, gr = rows(got)
    wn, wr = rows(want)
    problems = []
    if gn != wn:
        return [f"columns {gn} vs {wn}"]
    gk, wk = kinds(got), kinds(want)
    diff = {n: (gk[n], wk[n]) for n in gn if gk[n] != wk[n] and not (gk[n].startswith("timestamp") and wk[n].startswith("timestamp"))}
    if diff:
        problems.append(f"types {diff}")
    if gr != wr:
        gs, ws = set(gr), set(wr)
        problems.append(f"rows {len(gr)} vs {len(wr)}; only spark {sorted(gs - ws)[:2]}; only sql {sorted(ws - gs)[:2]}")
    return problems


def main(argv):
    from codeloom.catalog import ORACLES, QUERIES
    from codeloom.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark, con = local_session(), connect(folder)
    bad = 0
    for key in keys:
        t = time.time()
        try:
            if key in ORACLES:
                problems = compare(spark, con, QUERIES[key], ORACLES[key], folder)
            else:
                n = QUERIES[key](spark, folder).count()
                problems = [] if n else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:350]}"]
        took = time.time() - t
        bad += bool(problems)
        if problems or took > 4:
            print(f"{'FAIL' if problems else 'slow'} {key} {took:.1f}s {' | '.join(problems)}", flush=True)
    print(f"{len(keys)} queries, {len([k for k in keys if k in ORACLES])} with SQL, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
