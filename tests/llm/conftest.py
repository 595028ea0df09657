import pytest


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
