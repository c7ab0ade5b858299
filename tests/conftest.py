import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("BENCH_CPUS", "4")


@pytest.fixture(scope="session")
def spark():
    from talkledger.session import local_session

    session = local_session(4, "tests")
    yield session
    session.stop()
