"""Every query of the library against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if hasattr(v, "normalize"):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert got == sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
