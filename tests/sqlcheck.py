"""A query's rows against those that DuckDB gives for its SQL over the same tables."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value in one form for both engines; floats to 10 digits."""
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return sorted((str(k), plain(x)) for k, x in v.items())
    return v


def same_rows(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    got = query(spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = Counter(repr([plain(r[c]) for c in order]) for r in got.collect())
    wanted = Counter(repr([plain(r[names.index(c)]) for c in order]) for r in cur.fetchall())
    assert mine == wanted, (list((mine - wanted).items())[:3], list((wanted - mine).items())[:3])
