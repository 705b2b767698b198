"""Result tables as Parquet, delimited text and an aligned vertex listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.graph import Graph, Partition


def _tables(graph: Graph, part: Partition) -> dict[str, DataFrame]:
    return {
        "graph-vertices": graph.vertices,
        "graph-edges": graph.edges,
        "part-vertices": part.modules,
        "part-edges": part.links,
    }


def write_parquet(graph: Graph, part: Partition, stem: str, ext: str = "") -> None:
    """The four tables as ``<stem>-<table><ext>`` in Parquet."""
    for name, table in _tables(graph, part).items():
        table.write.parquet(f"{stem}-{name}{ext}")


def write_text_tables(graph: Graph, part: Partition, stem: str, ext: str = "") -> None:
    """The four tables as comma-separated text directories."""
    for name, table in _tables(graph, part).items():
        table.write.csv(f"{stem}-{name}{ext}")


def vertex_lines(graph: Graph) -> DataFrame:
    """``(part, id, line)``: an aligned listing of id, name and module; the header is part 0."""
    named = graph.vertices.select("id", F.coalesce("name", F.lit("")).alias("name"), "module")
    # The name column is as wide as the longest name, at least 4.
    width = named.agg(
        F.greatest(F.max(F.length("name")), F.lit(4)).alias("width")
    ).scalar()
    padded = F.expr("rpad(name, width, ' ')")
    rows = named.withColumn("width", width).select(
        F.lit(1).alias("part"), "id",
        F.format_string("%7d | %s | %7d", F.col("id"), padded, F.col("module")).alias("line"),
    )
    header = graph.spark.range(1).withColumn("width", F.coalesce(width, F.lit(4))).select(
        F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("id"),
        F.concat(F.lit("Index   | "), F.expr("rpad('Name', width, ' ')"), F.lit(" | Module ")).alias("line"),
    )
    return header.unionByName(rows)


def write_vertex_table(graph: Graph, path: str) -> None:
    """:func:`vertex_lines` as ordered part files; joined in name order they are the listing."""
    vertex_lines(graph).orderBy("part", "id").select("line").write.text(path)
