import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    s = local_session("tests", cpus=4, partitions=4, memory="4g")
    yield s
    s.stop()
