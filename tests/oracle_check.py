"""Compare registered queries with their SQL twins: python -m tests.oracle_check [sf] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import threading
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("num", v + 0.0)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("num", float(v))
    if isinstance(v, decimal.Decimal):
        return ("num", float(v))
    if isinstance(v, datetime.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_sorted(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith(("bigint", "int", "smallint", "tinyint", "hugeint", "long")):
        return "int" if not t.startswith("hugeint") else "hugeint"
    return {"varchar": "string", "float": "float", "timestamp_ntz": "timestamp"}.get(t, t)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when both sides agree, else a description of the difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = rows_sorted(df.select(*cols).collect())
    if sql is None:
        return None if got else "no rows"
    guard = threading.Timer(120, con.interrupt)
    guard.start()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: kind(str(d[1])) for d in rel.description}
    data = rel.fetchall()
    guard.cancel()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    spark_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    for c in cols:
        if "[" in types[c] or "struct" in types[c]:
            continue
        if spark_types[c] != types[c]:
            return f"type of {c}: {spark_types[c]} vs {types[c]}"
    idx = [names.index(c) for c in cols]
    want = rows_sorted([tuple(r[i] for i in idx) for r in data])
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; cols {cols}; first {got[:2]} vs {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; cols {cols}; e.g. {bad[0][0]} vs {bad[0][1]}"
    return None if got else "EMPTY"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from stratapanel.session import local_session

    sf_dir = "/root/testdata/sf" + (argv[0] if argv else "0.01")
    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n == a or n.startswith(a + "*") or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, n, queries[n], oracles.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            msg = f"ERROR {type(e).__name__} {str(e)[:900]}"
        took = time.time() - t
        if msg:
            bad += 1
            print(f"BAD {n} ({took:.1f}s): {msg}", flush=True)
        elif took > 4 or len(names) < 4:
            print(f"ok  {n} ({took:.1f}s){'' if n in oracles else ' rows-only'}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
