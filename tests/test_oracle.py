"""Every query of the reference's operators against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from triagelake.plans import oracle, queries


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if isinstance(value, int) else str(value)


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, db, name):
    frame = queries.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in oracle.ORACLE_SQL:
        return
    found = db.sql(oracle.ORACLE_SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
