import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rainshade.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shuffle_partitions=8)
    yield session
    session.stop()
