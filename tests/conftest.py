import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ropeway.session import ROWS_PER_TASK, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture
def tiny_tasks(spark):
    """Every key above a handful of rows takes the split path."""
    spark.conf.set(ROWS_PER_TASK, "8")
    yield spark
    spark.conf.unset(ROWS_PER_TASK)
