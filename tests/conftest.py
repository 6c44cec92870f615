import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from verdex.session import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "8")), "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
