import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from factlane.session import ensure_checkpoint_dir, local_session

    s = local_session("4", 4, app="factlane-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


SMOKE_DIR = "/root/testdata/sf0.001"
