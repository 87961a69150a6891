"""Every registered query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import duck, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()
# The smallest tables have no secrets in their documents; the next larger ones do.
RICH_DIR = os.environ.get("TEST_RICH_DIR", "/root/testdata/sf0.01")
NEEDS_RICH = {"h24_secrets_documents", "x02_secrets_documents", "x10_shared_state", "x11_no_sync", "corpus_rollup", "secret_risk_by_source"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return {sf_dir: duck(sf_dir) for sf_dir in (SF_DIR, RICH_DIR)}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, tables, name):
    sf_dir = RICH_DIR if name in NEEDS_RICH else SF_DIR
    names, rows = spark_rows(entry.queries()[name](spark, sf_dir))
    if name in ORACLE:
        expected_names, expected = duck_rows(tables[sf_dir], ORACLE[name])
        assert names == expected_names
        assert rows == expected
    assert rows


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
