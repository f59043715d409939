import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (os.path.join(ROOT, "tests"), ROOT):
    if folder not in sys.path:
        sys.path.insert(0, folder)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetpulse.session import build_session, checkpoint_dir

    s = build_session("local[4]", 8)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from fleetpulse.checks.compare import duck_connect

    return duck_connect(SF_SMALL)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
