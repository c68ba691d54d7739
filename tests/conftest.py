import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from deliverix.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8)
    yield s
    from deliverix.plans.build import release_all
    release_all()
    s.stop()
