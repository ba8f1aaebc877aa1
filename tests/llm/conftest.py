import pytest


@pytest.fixture(scope="session", autouse=True)
def swept(spark):
    """Intermediate tables go when the tests are over."""
    yield
    from kilnbase.llm import common

    common.sweep(spark)
