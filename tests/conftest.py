import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom.plans.tables import Tables  # noqa: E402
from docloom.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    Tables.spread = 8
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from tests.oracle import connect

    return connect(SF)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
