import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import local_session

    return local_session("4", "6g")


@pytest.fixture()
def files(spark):
    def make(*pairs):
        return spark.createDataFrame(list(pairs), "file_path string, text string")

    return make
