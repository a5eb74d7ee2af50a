import importlib.util
import os

import pytest
from oracle import compare, connect

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.01"

spec = importlib.util.spec_from_file_location("entry_module", f"{ROOT}/__spark_entry__.py")


def _entry():
    import sys

    sys.path.insert(0, ROOT)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


ENTRY = _entry()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ENTRY.queries()))
def test_query_matches_oracle(spark, con, name):
    df = ENTRY.queries()[name](spark, SF_DIR)
    sql = ENTRY.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        compare(df, con, sql)


def test_entry_runs(spark):
    df = ENTRY.entry(spark)
    assert df.count() > 0
