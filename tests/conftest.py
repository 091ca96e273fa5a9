import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from bankspark.plans.session import get_session

    s = get_session("local[*]", app="bankspark-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def raw0001(spark):
    from bankspark.sources.bankviews import bank_tables

    return bank_tables(spark, SF0001)


@pytest.fixture(scope="session")
def prep0001(raw0001):
    from bankspark.operators.prep import prepare

    return prepare(raw0001)
