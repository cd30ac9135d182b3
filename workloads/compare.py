"""Run queries next to their SQL: ``python -m workloads.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from textloom.session import local_session
from workloads.oracles import ORACLES
from workloads.queries import QUERIES

TABLES_DIR = "/root/testdata/sf0.01"


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("", None)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return ("n", round(float(value), 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return ("l", tuple(_norm(v) for v in value))
    return ("s", str(value))


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else TABLES_DIR
    wanted = argv[1:] or list(QUERIES)
    spark = local_session(8)
    duck = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows-only {name} rows={len(got[1])} {spent:.1f}s", flush=True)
                continue
            start = time.time()
            cursor = duck.execute(ORACLES[name])
            expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
            duck_spent = time.time() - start
        except Exception as error:  # report and go on with the next query
            failed += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        same = got == expected
        failed += not same
        print(
            f"{'ok' if same else 'DIFFERENT'} {name} rows={len(got[1])}/{len(expected[1])} "
            f"spark={spent:.1f}s duckdb={duck_spent:.1f}s",
            flush=True,
        )
        if not same:
            print("   columns", got[0], expected[0])
            for a, b in [(a, b) for a, b in zip(got[1], expected[1]) if a != b][:2]:
                print("   got     ", str(a)[:400])
                print("   expected", str(b)[:400])
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
