from __future__ import annotations

import pytest
from oracle import compare, connect, entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert entry.registry.queries().keys() == entry.registry.oracle_sql().keys()


@pytest.mark.parametrize("name", entry.registry.queries())
def test_matches_sql(spark, duck, name):
    rows, _ = compare(spark, duck, SF_DIR, name)
    assert rows > 0 or name in ("quadrant_21", "quadrant_22")  # ten suppliers: one row of blocks


def test_entry(spark):
    df = entry.entry(spark)
    assert df.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "double")]
    assert df.count() > 0
