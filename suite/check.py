"""Run registered queries next to their SQL: python -m suite.check [name-prefix ...]  (SF_DIR, default sf0.01)."""

import math
import os
import sys
import time

import duckdb

from corpusloom.session import local
from suite import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "as_integer_ratio"):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.6g}" if number % 1 else str(int(number))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main(wanted):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            began = time.time()
            df = fn(spark, sf)
            columns, got = rows_of(df.columns, df.collect())
            took = time.time() - began
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name}: spark {str(error)[:1500]}", flush=True)
            continue
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            began = time.time()
            result = con.execute(ORACLES[name])
            names, expected = rows_of([c[0] for c in result.description], result.fetchall())
            sql_took = time.time() - began
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name}: sql {str(error)[:1500]}", flush=True)
            continue
        if names == columns and got == expected:
            print(f"ok   {name}: {len(got)} rows {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
            continue
        bad.append(name)
        print(f"FAIL {name}: {len(got)} rows, expected {len(expected)}; columns {columns} / {names}")
        extra, missing = set(got) - set(expected), set(expected) - set(got)
        for label, some in (("only here", extra), ("only in sql", missing)):
            for row in sorted(some)[:3]:
                print(f"   {label}: {tuple(c[:300] for c in row)}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
