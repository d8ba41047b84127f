from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskweave.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def scored(spark):
    """Six rows whose curve is worked out by hand in the tests."""
    p = [0.95, 0.85, 0.55, 0.45, 0.10, 0.05]
    y = [1, 0, 1, 1, 0, 1]
    rows = [(f"t{i}", float(10 * (i + 1)), y[i], p[i]) for i in range(6)]
    return spark.createDataFrame(rows, "transaction_id string, amount double, y int, p double")


def rows(df, *columns):
    """Sorted tuples of a small result."""
    names = columns or df.columns
    return sorted(tuple(r[c] for c in names) for r in df.select(*names).collect())
