import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from veldt import session

    s = session.local(8, "6g", "tests")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
