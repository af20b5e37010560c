"""Runs a query and its SQL side by side; used by the tests and before commits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from quarrylight.session import TABLES


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "normalize") and hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value)


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([[_plain(r[i]) for i in order] for r in rows], key=repr)


def compare(df: DataFrame, con, sql: str) -> str:
    """What differs, or nothing."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        odd = [x for x in got if x not in want][:2], [x for x in want if x not in got][:2]
        return f"{len(got)} rows against {len(want)}: only here {odd[0]}, only there {odd[1]}"
    return ""
