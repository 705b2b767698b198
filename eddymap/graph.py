"""The data model: a directed weighted graph and a partition of it into modules."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("module", T.LongType()),
])
EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("weight", T.DoubleType()),
])
TRACE_SCHEMA = T.StructType([
    T.StructField("round", T.IntegerType()),
    T.StructField("modules", T.LongType()),
    T.StructField("links", T.LongType()),
    T.StructField("codelength", T.DoubleType()),
    T.StructField("delta", T.DoubleType()),
])


@dataclass(frozen=True)
class Graph:
    """Vertices ``(id, name, module)`` and directed edges ``(src, dst, weight)``."""

    vertices: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def with_vertices(self, vertices: DataFrame) -> "Graph":
        return replace(self, vertices=vertices)


@dataclass(frozen=True)
class Partition:
    """Modules ``(module, n, p, w, q)``, the flow ``(src, dst, weight)`` between them, and scalars."""

    modules: DataFrame
    links: DataFrame
    n_nodes: int
    tele: float
    prob_sum: float
    codelength: float
    q_sum: float
    n_modules: int
    n_links: int


def sum_parallel_edges(edges: DataFrame) -> DataFrame:
    """One row per ``(src, dst)`` with the summed weight."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def unknown_endpoints(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids used by an edge but absent from the vertex table.

    The ends are made distinct before the join, so a hub costs one row per map task.
    """
    ends = (
        edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    )
    return ends.join(vertices, "id", "left_anti")


def check_endpoints(graph: Graph) -> None:
    stray = unknown_endpoints(graph.vertices, graph.edges).agg(F.min("id").alias("id")).first()
    if stray.id is not None:
        raise ValueError(f"edge endpoint {stray.id} is not in the vertex table")


def without_stray_edges(graph: Graph) -> Graph:
    """The graph without the edges that leave the vertex table."""
    known = graph.vertices.select("id")
    links = (
        graph.edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select("src", "dst", "weight")
    )
    return Graph(graph.vertices, links)


def graph_from_tables(vertices: DataFrame, edges: DataFrame, strict: bool | None = True) -> Graph:
    """Build a graph from two tables, taken by position and cast.

    ``vertices`` has an id and optionally a name; every vertex starts as its own module.  Parallel
    edges are summed.  ``strict=True`` raises if an edge leaves the vertex table, ``strict=False``
    drops such edges and ``strict=None`` trusts the caller.
    """
    id_col = vertices.columns[0]
    name_col = vertices.columns[1] if len(vertices.columns) > 1 else id_col
    nodes = vertices.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(name_col).cast("string").alias("name"),
    ).withColumn("module", F.col("id"))
    src, dst, weight = edges.columns[:3]
    links = sum_parallel_edges(edges.select(
        F.col(src).cast("bigint").alias("src"),
        F.col(dst).cast("bigint").alias("dst"),
        F.col(weight).cast("double").alias("weight"),
    ))
    graph = Graph(nodes, links)
    if strict is False:
        return without_stray_edges(graph)
    if strict:
        check_endpoints(graph)
    return graph
