import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lexigraph.session import checkpoint_dir, get_spark
    s = get_spark(4, 4, app="lexigraph-tests", memory="6g")
    checkpoint_dir(s)
    yield s
    s.stop()
