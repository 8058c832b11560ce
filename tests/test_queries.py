"""Every query of the engine against its DuckDB SQL on whole tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from tallyspark.plans.oracle import NO_SQL, ORACLE
from tallyspark.plans.queries import QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return f"{v:f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for n in NAMES:
        path = Path(f"{sf}/{n}.parquet")
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) | NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    assert len(got) == len(want)
    assert got == want
