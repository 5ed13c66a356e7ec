"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quern.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = norm(tuple(r) for r in got.select(*cols).collect())
    assert rows or name == "qa_filtered"
    if name in catalogue.ORACLES:
        rel = db.sql(catalogue.ORACLES[name])
        assert sorted(rel.columns) == cols
        assert rows == norm(rel.select(*[f'"{c}"' for c in cols]).fetchall())
