import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from marketframe.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()
