"""Choose a reader by file extension."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from eddymap.graph import Graph
from eddymap.sources.pajek import read_pajek
from eddymap.sources.parquet import read_parquet_graph

READERS = {"net": read_pajek, "parquet": read_parquet_graph}


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Read ``.net`` (Pajek) or ``.parquet`` (manifest) and keep both tables for later passes."""
    found = re.fullmatch(r".*\.(\w+)", path, re.DOTALL)
    if not found:
        raise ValueError(f"cannot choose a reader: file name without an ending: {path}")
    reader = READERS.get(found.group(1).lower())
    if reader is None:
        raise ValueError(f"no reader for files ending in .{found.group(1)}; known: {', '.join(READERS)}")
    graph = reader(spark, path)
    return Graph(
        graph.vertices.persist(StorageLevel.MEMORY_AND_DISK),
        graph.edges.persist(StorageLevel.MEMORY_AND_DISK),
    )
