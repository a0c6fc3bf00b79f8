"""Every registered query against its SQL twin; the others must return rows."""

import pytest

from docloom.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(result, duck, ORACLES[name]) == []
    else:
        assert result.count() > 0
