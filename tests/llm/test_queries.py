"""The training-data queries against their SQL twins; the others by brute force elsewhere."""

import pytest

from docloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
