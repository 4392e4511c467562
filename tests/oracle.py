"""Compare registered queries with their SQL in an in-process DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return cell(v.item())
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(cell(v) for v in r) for r in frame.itertuples(index=False)), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def same(a, b, exact: bool) -> bool:
    if isinstance(a, float) and isinstance(b, float) and not exact:
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and (a is None) == (b is None)


def compare(got: pd.DataFrame, want: pd.DataFrame, exact: bool = True) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} <> {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}"
    for x, y in zip(a, b):
        if not all(same(p, q, exact) for p, q in zip(x, y)):
            return f"values {x} <> {y}"
    return None


def kinds(spark_frame, duck_types: dict[str, str]) -> list[str]:
    """Columns whose type families differ between the engines."""
    family = {"bigint": "int64", "int": "int32", "integer": "int32", "double": "double", "string": "text", "varchar": "text", "boolean": "bool", "hugeint": "int128"}
    out = []
    for f in spark_frame.schema.fields:
        a, b = f.dataType.simpleString(), duck_types[f.name].lower()
        if family.get(a, a) != family.get(b, b):
            out.append(f"{f.name}: {a} <> {b}")
    return out


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from siltworks.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    chosen = [n for n in qs if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for n in chosen:
        t = time.time()
        try:
            frame = qs[n](spark, folder)
            got = frame.toPandas()
            took = time.time() - t
            if n not in sqls:
                print(f"rows  {n}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            rel = con.sql(sqls[n])
            types = dict(zip(rel.columns, map(str, rel.types)))
            problem = compare(got, rel.df(), exact=True)
            wrong = kinds(frame, types) if problem is None else []
            loose = problem and compare(got, con.sql(sqls[n]).df(), exact=False)
            note = "" if problem is None else (" (float noise only) " if loose is None else " ")
            bad += problem is not None or bool(wrong)
            print(f"{'ok   ' if problem is None and not wrong else 'DIFF '} {n}: {len(got)} rows, {took:.1f}s{note}{(problem or '')[:600]} {wrong or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {n}: {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
