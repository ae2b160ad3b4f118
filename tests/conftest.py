from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from scriptorium.session import local_session, shipped

    return shipped(local_session(4, partitions=4, memory="3g"))
