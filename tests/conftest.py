import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle import local_session
    from riskframe import ship_package
    session = local_session(os.environ.get("TEST_CPUS", "8"))
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    yield session
    session.stop()
