import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from counterfoil.session import get_session, ensure_checkpoint_dir
    s = get_session("local[4]", app="counterfoil-tests", shuffle_partitions=4,
                    conf={"spark.driver.memory": "4g"})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="counterfoil-test-", dir="/tmp")
