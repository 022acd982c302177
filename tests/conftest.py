import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fadewatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    yield s
    s.stop()
