import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import networks  # noqa: E402

from eddymap import Graph  # noqa: E402
from eddymap.graph import EDGE_SCHEMA, VERTEX_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def net(spark):
    """A small test network as a graph."""
    def build(name):
        return Graph(
            spark.createDataFrame(networks.vertices(name), VERTEX_SCHEMA),
            spark.createDataFrame(networks.edges(name), EDGE_SCHEMA),
        )
    return build


@pytest.fixture
def text_file(tmp_path):
    """Write text (Latin-1) to a new file and return its path."""
    def write(text, name="graph.net"):
        path = tmp_path / name
        path.write_bytes(text.encode("latin-1"))
        return str(path)
    return write
