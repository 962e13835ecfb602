"""Compare registered queries with their SQL twins: python check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(series: pd.Series) -> str:
    return {"i": "int", "u": "int", "f": "float", "M": "time", "b": "bool"}.get(series.dtype.kind, "obj")


def canonical(table) -> tuple[list[str], list[tuple], dict]:
    table = table.select(sorted(table.column_names))
    kinds = {f.name: str(f.type).replace("large_", "") for f in table.schema}
    def clean(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v
    rows = sorted((tuple(clean(v) for v in row.values()) for row in table.to_pylist()), key=repr)
    return table.column_names, rows, kinds


def compare(spark_table, duck_table) -> str | None:
    names, rows, kinds = canonical(spark_table)
    want_names, want_rows, want_kinds = canonical(duck_table)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want_rows):
        return f"{len(rows)} rows, expected {len(want_rows)}"
    for got, want in zip(rows, want_rows):
        if got != want:
            return f"row {got} != {want}"
    loose = {
        n: (kinds[n], want_kinds[n])
        for n in names
        if kinds[n].rstrip("0123456789") != want_kinds[n].rstrip("0123456789")
        and not kinds[n].startswith("timestamp")
    }
    return f"types {loose}" if loose else None


def main(argv: list[str]) -> int:
    from slotcast.session import local_session
    from slotcast.workload import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8, name="check")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in argv[1:] or QUERIES:
        begin = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toArrow()
            took = time.time() - begin
            if name in ORACLES:
                problem = compare(got, con.sql(ORACLES[name]).to_arrow_table())
            else:
                problem = None if got.num_rows else "no rows"
        except Exception as error:  # report and go on
            took, problem = time.time() - begin, f"{type(error).__name__}: {str(error)[:600]}"
            got = None
        bad += problem is not None
        rows = got.num_rows if got is not None else "-"
        print(f"{'BAD' if problem else 'ok ':3} {name:32} {took:6.2f}s {rows} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
