"""Runs queries against their SQL on the same files and reports differences.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""
import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.registry import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    return None if v is None else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, x or "") for x in r))


def compare(spark, con, name, sf):
    """Empty text when equal, else what differs."""
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return ""
    only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} != {len(b)}; {sorted(names)}\n   spark {only_a}\n   sql   {only_b}"


def main():
    from coverlens.session import local_session
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            diff = compare(spark, con, name, sf) if name in ORACLE else "no SQL"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff)
        print(f"{'ok ' if not diff else 'BAD'} {name} {time.time() - start:.1f}s {diff}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
