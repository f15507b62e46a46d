"""Runs a registered query and its SQL side by side and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return str(v.normalize())
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def compare(spark, con, fn, sql, folder):
    """None when equal, else a text that says what differs."""
    df = fn(spark, folder)
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    ours = sorted((tuple(cell(v) for v in row) for row in df.select(*cols).collect()), key=key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    idx = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted((tuple(cell(row[i]) for i in idx) for row in cur.fetchall()), key=key)
    if cols != sorted(names):
        return f"columns {cols} against {sorted(names)}"
    for c in cols:
        spark_double = types[c] == "double"
        if spark_double != (kinds[c] in ("DOUBLE", "NUMBER") and "DOUBLE" in kinds[c]) and spark_double != ("DOUBLE" in kinds[c]):
            return f"type of {c}: {types[c]} against {kinds[c]}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, columns {cols}, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return f"ok {len(ours)}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from driftmark.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, fn, oracles[name], folder)
            else:
                result = f"ok rows-only {fn(spark, folder).count()}"
        except Exception as exc:  # report and go on with the next query
            result = f"{type(exc).__name__}: {str(exc)[:600]}"
            if isinstance(exc, duckdb.Error):
                con = duck(folder)
        if not result.startswith("ok"):
            failed.append(name)
        print(f"{name:36s} {time.time() - start:6.2f}s  {result}", flush=True)
    print("FAILED:", failed)


if __name__ == "__main__":
    main()
