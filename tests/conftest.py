import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from stratalyn.plans.session import local_session, shared_dir

    s = local_session("4", "6g")
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    yield s
    s.stop()
