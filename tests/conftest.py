import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from inkspan.session import build_session

    s = build_session("tests", master="local[8]", cores=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
