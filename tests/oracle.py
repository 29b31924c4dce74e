"""Runs registered queries next to their SQL twins. Usage: python tests/oracle.py SF [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if v is None:
        return ("0", "")
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return ("n", "nan" if math.isnan(f) else f"{f:.6f}")
    return ("s", str(v))


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, otherwise a description of the difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted([tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} / {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = sorted([tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()])
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)}, sql {len(want)}\n  {got[:3]}\n  {want[:3]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({cols})\n" + "\n".join(f"  spark {a}\n  sql   {b}" for a, b in bad[:4])
    return None


def main():
    import __spark_entry__ as entry
    from netsift.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, fn, oracles.get(name), sf)
        except Exception as exc:  # report and go on with the next query
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += diff is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind} {name} {time.time() - t:.1f}s" + (f"\n{diff}" if diff else ""), flush=True)
    print(f"failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
