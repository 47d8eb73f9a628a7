import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("HISTLAKE_DRIVER_MEMORY", "6g")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from histlake.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
