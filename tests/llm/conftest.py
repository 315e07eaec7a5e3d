import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shared import SCHEMA, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def odd():
    return odd_texts()


@pytest.fixture()
def frame(spark):
    def make(docs):
        return spark.createDataFrame([(d, t, None, "s", None, 1, "x", "y", 0.5, 3, "z") for d, t in docs], SCHEMA).repartition(5)
    return make
