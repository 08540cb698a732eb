import pytest

from massloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    ship_package(session)
    yield session
    session.stop()
