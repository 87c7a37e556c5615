import pytest

from spanloom.session import local


@pytest.fixture(scope="session")
def spark():
    return local(4, "4g", 4)
