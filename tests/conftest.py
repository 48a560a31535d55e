import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from trellisq.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
