import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(monkeypatch):
    """Every lookup takes the salted path, and a key with more than 20 rows counts as hot."""
    from driftgrid import spread

    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(spread, "ROWS_PER_TASK", 20)
