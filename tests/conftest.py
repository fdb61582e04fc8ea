import pytest

from orrery.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores=4, shuffle_partitions=4)
    yield s
    s.stop()
