import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SHUFFLE_PARTITIONS", "4")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session(4, "tests", "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
