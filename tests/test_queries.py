"""Every registered evaluation query against its SQL in DuckDB."""
import math

import duckdb
import numpy as np
import pytest

from clinograph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return connection


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.6g}" if isinstance(x, (int, float, np.number)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, data_dir, name):
    got = catalog.QUERIES[name](spark, data_dir)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name not in catalog.ORACLE_SQL:
        assert columns  # results that SQL can't give have tests of their own
        return
    want = db.sql(catalog.ORACLE_SQL[name])
    place = [want.columns.index(c) for c in columns]
    assert len(want.columns) == len(columns)
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
