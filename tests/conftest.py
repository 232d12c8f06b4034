import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from arborlight.plans.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
