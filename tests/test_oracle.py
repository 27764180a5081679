"""Every registered query against its SQL answer on the smallest tables."""

from __future__ import annotations

import os

import pytest

import check
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    want = con.execute(ORACLE[name]).df()
    assert len(want)
    assert check.difference(QUERIES[name](spark, SF).toPandas(), want) is None
