import os
import sys
from pathlib import Path

import numpy as np
import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), os.environ.get("PYTHONPATH", "")])  # test doubles run in tasks

from themeloom.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_vectors(spark):
    """A vector table from a matrix, row ids counting from 0."""

    def make(matrix):
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(matrix))]
        return spark.createDataFrame(rows, "row_id long, embedding array<double>")

    return make


@pytest.fixture(scope="session")
def blobs():
    """Three clouds of 40 around the axes."""
    random = np.random.default_rng(42)
    return np.concatenate([center + random.normal(0, 0.05, (40, 3)) for center in np.eye(3)])


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def by_row(df, column="cluster_id"):
    return np.array([r[column] for r in df.orderBy("row_id").select(column).collect()])
