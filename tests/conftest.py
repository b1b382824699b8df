import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("AUDITGRAIN_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from auditgrain.session import local_session

    session = local_session(8, "auditgrain-tests", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
