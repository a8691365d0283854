import importlib.util

import pytest

from tallymill.plans.catalog import QUERIES
from verification.compare import oracle_connection, same_rows
from verification.oracle import ORACLE_SQL

from conftest import ROOT


@pytest.fixture(scope="session")
def oracle(small):
    return oracle_connection(small)


def test_every_query_has_its_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, oracle, name):
    found = QUERIES[name](spark, small)
    assert same_rows(found, oracle, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("limit, left", [("65535", 8000), ("100", 100)])
def test_all_scored_columns_run_compiled_in_any_session(spark, small, limit, left):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, limit)
        QUERIES["commerce_scored"](spark, small)
        assert int(spark.conf.get(name)) == left
    finally:
        spark.conf.set(name, before)


def test_entry(spark, small):
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(QUERIES) <= set(module.queries()) and set(ORACLE_SQL) <= set(module.oracle_sql())
    assert set(module.oracle_sql()) <= set(module.queries())
