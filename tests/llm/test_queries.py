"""Every query of the subpackage that has SQL against it, and the shape of the native ones."""

import os

import duckdb
import pytest

from docloom.llm.queries import CHECKS, QUERIES
from tests.conftest import plan_of
from tools.check import same_rows

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are missing")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF_DIR)):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF_DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    result = tables.sql(CHECKS[name])
    problem = same_rows(result.columns, result.fetchall(), df.columns, [tuple(r) for r in df.collect()])
    assert problem is None, problem


@pytest.mark.parametrize("name", ["op2_url_filters", "op5_quality_rules"])
def test_native_queries_run_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Join"))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
