import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscope.runtime import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with the awkward cases: empty, punctuation only, NULL, apostrophes, quotes, repeated words."""
    rows = [
        (1, "The cat, the hat."), (2, ""), (3, "!!! ... ---"), (4, None), (5, "don't stop; don't"),
        (6, 'a\t"quoted"\nline  the'), (7, "zebra"), (8, "The THE the cat"),
    ]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
