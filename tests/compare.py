"""Runs driver queries and their SQL side by side: python tests/compare.py [sf] [names...]."""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from dialogweave.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(table, key=lambda r: tuple((x is not None, str(x)) for x in r))


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, sf_dir):
    """None when equal, else a description of the difference."""
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in oracle_sql():
        return None
    cursor = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"values\n  spark  {a}\n  oracle {b}"
    return None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    session, link = local_session(8), connect(folder)
    bad = 0
    for query in sys.argv[2:] or queries():
        start = time.time()
        try:
            problem = compare(session, link, query, folder)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{query:40s} {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print("different:", bad)
