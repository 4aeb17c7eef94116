import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/tidemark-warehouse"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
