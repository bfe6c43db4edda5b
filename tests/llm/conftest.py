import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    from samples import documents
    return documents(spark).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    from samples import documents
    return documents(spark, [])
