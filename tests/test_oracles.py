"""Every query with oracle SQL gives the same rows in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import oracle
import pytest

from fathomline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees(spark, db, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), db, registry.ORACLE_SQL[name]) == []


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
