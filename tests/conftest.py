import pytest

from docmill.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
