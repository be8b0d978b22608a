"""Every query with SQL gives the rows of its SQL; the others give rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tsquorum.plans import kernel_queries, registry, report_queries, series_queries  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [dict(zip(df.columns, r, strict=True)) for r in map(tuple, df.collect())]
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [norm(r[c]) for c in sorted(r)]
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    """Rows, columns with different names, and finite or null numbers."""
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert all(math.isfinite(x) for r in rows for x in r if isinstance(x, float) and not math.isnan(x)) and any(x is not None and x == x for x in rows[0])
