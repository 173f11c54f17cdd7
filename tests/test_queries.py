"""Every registered query against its checking SQL at the smallest scale.

The corpus operators (opN_..., pipeline) have their own tests in tests/llm.
"""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import check, database

SF_DIR = "/root/testdata/sf0.001"
RUNS, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(RUNS)


@pytest.mark.parametrize("name", sorted(n for n in RUNS if not re.match(r"op\d+_|pipeline$", n)))
def test_query(spark, con, name):
    verdict = check(spark, con, SF_DIR, name, RUNS[name], ORACLES.get(name))
    assert not verdict.startswith("FAIL"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
