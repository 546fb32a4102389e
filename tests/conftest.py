import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="lanecast-tests-")
    os.environ["LANECAST_SCRATCH"] = scratch
    from lanecast.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app="lanecast-tests",
                      extra={"spark.checkpoint.dir": f"{scratch}/ckpt"})
    yield s
    s.stop()


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lanecast-t-")
