import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessaro.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=2, memory="4g")
    ship(session)
    yield session
    session.stop()
