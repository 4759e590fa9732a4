import pytest

from scorewright.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    return s
