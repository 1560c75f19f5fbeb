"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tessera.plans import catalogue

from .compare import of_duck, of_spark

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, name):
    got = of_spark(catalogue.queries()[name](spark, FOLDER))
    assert name in catalogue.oracle_sql()
    assert got == of_duck(FOLDER, catalogue.oracle_sql()[name])


def test_every_query_says_what_it_covers():
    assert set(catalogue.covers()) == set(catalogue.queries())
    assert all(f.__doc__ for f in catalogue.queries().values())
