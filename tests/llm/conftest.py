import pytest


@pytest.fixture(scope="session")
def small_docs(spark):
    from tests.conftest import SMALL
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_labels(spark):
    from tests.conftest import SMALL
    return spark.read.parquet(f"{SMALL}/labels.parquet")
