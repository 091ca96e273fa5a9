"""Every registered query against its DuckDB oracle at sf0.001 (model queries: rows only)."""

import pytest

import __spark_entry__ as E
from bankspark.plans.registry import QUERIES as BANK

from .conftest import SF0001
from .oracle_check import compare, duck

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_bank_query_has_an_oracle_or_follows_from_the_iterative_fit():
    rows_only = {n for n in BANK if n not in SQL}
    assert rows_only == {"c1_fit_coefficients", "c1_model_metrics", "c1_model_report", "c_score_loans", "kpi_summary_with_models"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 15 and df.columns == ["kpi", "value"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    # strict: the rounded doubles of both engines must be bit-identical
    status, msg = compare(spark, con, name, QUERIES[name], SQL.get(name), SF0001, strict=True)
    assert status in ("OK", "ROWS"), msg
