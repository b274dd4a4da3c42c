import pytest


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
