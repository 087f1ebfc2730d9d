"""Runs a registered query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

from coreloom.plans.derived import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if isinstance(v, int) else str(v)


def compare(spark, query, sql: str, sf_dir: str = SF_DIR) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = [dict(zip(names, row)) for row in result.fetchall()]
    got = [row.asDict() for row in query(spark, sf_dir).collect()]
    cols = sorted(names)
    rows = lambda found: sorted((tuple(plain(r[c]) for c in cols) for r in found), key=repr)
    assert len(got) == len(want)
    if got:
        assert sorted(got[0]) == cols
    assert rows(got) == rows(want)
