import pytest
from eventide.llm.store import find_package


@pytest.fixture(autouse=True, scope="session")
def package(spark):
    find_package(spark)
