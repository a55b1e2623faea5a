import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from embercast.session import build_session
    os.environ.setdefault("EMBERCAST_DRIVER_MEMORY", "6g")
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="embercast-tests")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
