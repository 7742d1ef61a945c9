"""Every registered query against its SQL twin, on the smallest given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from registry.oracle import oracle
from registry.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_query_but_the_trained_index_has_sql():
    assert set(QUERIES) - set(oracle()) == {"ivf_kmeans"}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    ok, text = compare(spark, SF_DIR, name)
    assert ok is not False, text


def test_entry(spark):
    assert entry(spark).columns == ["req_id", "rank", "media_id", "score"]
