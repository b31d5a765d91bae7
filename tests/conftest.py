import pytest

from areascope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("areascope-tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
