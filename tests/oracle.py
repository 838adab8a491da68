"""Run registered queries next to their DuckDB oracle: python tests/oracle.py [-s sf] [prefix ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differs(spark_rows, spark_names, duck_rows, duck_names):
    if sorted(spark_names) != sorted(duck_names):
        return f"columns {spark_names} vs {duck_names}"
    a, b = normal(spark_rows, spark_names), normal(duck_rows, duck_names)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, columns {sorted(spark_names)}, first {bad[:3]}" if bad else None


def main(argv):
    from ondula.plans import REGISTRY, load
    from ondula.session import local_session
    sf = "/root/testdata/sf0.01"
    only = []
    mods = None
    while argv:
        a = argv.pop(0)
        if a == "-s":
            sf = f"/root/testdata/sf{argv.pop(0)}"
        elif a == "-m":
            import importlib
            mods = argv.pop(0).split(",")
            for m in mods:
                importlib.import_module(f"ondula.plans.{m}")
        else:
            only.append(a)
    if mods is None:
        load()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    good = bad = 0
    for name, q in list(REGISTRY.items()):
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time() - t0
            if q.sql is None:
                note = f"rows only: {len(rows)} {rows[:1]}" if rows else "NO ROWS"
                ok = bool(rows)
            else:
                t2 = time.time()
                cur = con.execute(q.oracle())
                names = [d[0] for d in cur.description]
                note = differs(rows, df.columns, cur.fetchall(), names)
                ok = note is None
                note = note or f"{len(rows)} rows, duckdb {time.time() - t2:.2f}s {rows[:1] if not rows else ''}"
        except Exception as e:
            ok, t1 = False, time.time() - t0
            note = (traceback.format_exc(limit=-3)[:300] + str(e)[:900])
        good, bad = good + ok, bad + (not ok)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {t1:.2f}s {str(note)[:1500]}", flush=True)
    print(f"{good} good, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
