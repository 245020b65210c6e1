import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexitide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """`(doc_id, rights_year, full_text)` from `(id, year, words)` rows."""

    def make(*rows):
        data = [(str(i), y, t.split() if t is not None else None) for i, y, t in rows]
        return spark.createDataFrame(data, "doc_id STRING, rights_year INT, full_text ARRAY<STRING>")

    return make
