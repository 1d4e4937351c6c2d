"""All registered queries equal their oracles on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


from cipherledger.plans.catalog import ORACLES, QUERIES  # noqa: E402


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, note = oracle.compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])
    assert ok, note


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["scan_id", "canonical", "surface"]
    assert df.take(1)
