import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def blobs(spark):
    """Three separated groups of 2-d points, a few copies, two far-off points."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(float(x), float(y)) for cx, cy in ((0, 0), (6, 0), (0, 7)) for x, y in rng.normal((cx, cy), 0.5, size=(40, 2))]
    rows += rows[:5] + [(30.0, 30.0), (-40.0, 25.0)]
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "id bigint, x double, y double").persist()
