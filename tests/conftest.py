import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomwork.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
