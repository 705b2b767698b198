"""Graphs stored as two Parquet tables named by a small JSON manifest."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from eddymap.graph import EDGE_SCHEMA, VERTEX_SCHEMA, Graph, graph_from_tables
from eddymap.sources.saved import checked

# Fixed keys of the manifest.
VERTEX_KEY = "Vertex File"
EDGE_KEY = "Edge File"


def read_parquet_graph(spark: SparkSession, manifest: str) -> Graph:
    """Read ``{"Vertex File": ..., "Edge File": ...}`` and the two tables it names, by position.

    Parallel edges are summed and every vertex starts as its own module.  A table with too few columns, or
    with one of another kind, raises.
    """
    entry = spark.read.json(manifest, multiLine=True).first()
    for key in (VERTEX_KEY, EDGE_KEY):
        if entry is None or key not in entry:
            raise ValueError(f"manifest {manifest} has no {key!r}")
    vertices = checked(spark.read.parquet(entry[VERTEX_KEY]), T.StructType(VERTEX_SCHEMA[:2]), VERTEX_KEY)
    edges = checked(spark.read.parquet(entry[EDGE_KEY]), EDGE_SCHEMA, EDGE_KEY)
    return graph_from_tables(vertices, edges, strict=None)
