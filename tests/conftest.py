import pytest

from trendloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, partitions=4)
    yield session
    session.stop()
