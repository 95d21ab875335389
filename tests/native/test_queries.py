"""Each registered query against its SQL on the smallest given tables."""

import datetime
import os

import duckdb
import pytest

import weftline.plans.queries as Q

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = Q.QUERIES[name](spark, SF), db.sql(Q.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in got.dtypes} == kinds
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
