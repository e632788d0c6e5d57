"""Every registered query against its SQL, row for row, on whole tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from proxies.oracles import ORACLES
from proxies.queries import QUERIES
from tests.helpers import plan

# DuckDB type -> Spark type it must come out as.
SAME_TYPE = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double",
             "BOOLEAN": "boolean", "DATE": "date"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = {c[0]: i for i, c in enumerate(want.description)}
    order = sorted(got.columns)
    assert sorted(columns) == order
    types = dict(got.dtypes)
    assert {c: SAME_TYPE[str(want.description[columns[c]][1])] for c in order} == types
    expected = Counter(tuple(row[columns[c]] for c in order) for row in want.fetchall())
    physical = plan(got)
    for mark in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"):
        assert mark not in physical
    actual = Counter(tuple(row) for row in got.select(*order).collect())
    assert actual == expected
    # Small tables fit one label file, which then has no faults to list.
    assert actual or name == "label_block_faults"


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["state_code", "visa_key", "i94yr", "i94mon", "people", "entries",
                              "state", "visa_broad_type"]
    assert not result.isEmpty()
