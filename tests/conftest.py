import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from firmground.session import local_session

    return local_session(partitions=4)


@pytest.fixture
def hot(spark):
    """So many chunks that every key is cut into several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
