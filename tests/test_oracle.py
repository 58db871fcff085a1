"""Every registered query gives what its SQL gives on the same tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tagloom.workloads.catalog import QUERIES as OWN
from tests.conftest import SF_DIR
from tools.check import compare

ORACLE = oracle_sql()
QUERIES = {name: run for name, run in queries().items() if name in OWN}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    result, _ = compare(spark, SF_DIR, name, QUERIES[name], ORACLE.get(name), duck)
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    assert entry(spark).count() == 24
