import pytest

from inkmill.session import build


@pytest.fixture(scope="session")
def spark():
    return build("local[4]", "tests")
