import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from regelspur.session import local_session, ship

    s = local_session(cores=4, partitions=4, memory="4g", **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    ship(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
