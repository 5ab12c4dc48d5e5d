"""Every query that has DuckDB SQL against it, on the smallest tables; the others run (their values are tested in
test_models.py) and give the same schema before and after they ran."""

import math

import duckdb
import numpy as np
import pytest

from strandlab.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.toArrow()
    assert rows.num_rows > 0 and rows.schema.names == df.columns
