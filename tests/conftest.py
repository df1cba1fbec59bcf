import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import build_session

    os.environ.setdefault("TIDEWATCH_DRIVER_MEMORY", "4g")
    s = build_session("tests", cores=4)
    yield s
    s.stop()
