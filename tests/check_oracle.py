"""Run registered queries against DuckDB: `python tests/check_oracle.py [sf] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: [str(x) for x in r])


def compare(df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    began = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    compare.duck = time.time() - began
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    loose = [f"{n}:{t}/{types[n]}" for n, t in df.dtypes if kinds.get(t) != types[n]]
    note = f" types {loose}" if loose else ""
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}{note}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, first {bad[0][0]} against {bad[0][1]}{note}"
    return note


def main(sf: str, wanted: list[str]) -> int:
    from pairloom.plans.catalog import CATALOG
    from pairloom.session import build_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failures = 0
    for name, q in CATALOG.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        compare.duck = 0.0
        try:
            df = q.run(spark, sf_dir)
            note = compare(df, con, q.sql) if q.sql else f" rows {df.count()}"
        except Exception as error:
            note = "ERROR " + str(error).replace("\n", " ")[:900]
        ok = not note or note.startswith(" rows")
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start - compare.duck:.1f}s (duckdb {compare.duck:.1f}s) {note}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "0.001", sys.argv[2:])))
