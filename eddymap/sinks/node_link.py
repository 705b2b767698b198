"""Node-link JSON documents written in parallel.

The document is a range-sorted table of lines: opening, nodes, middle, links, closing.  Each task
writes its range, and the part files joined in name order are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymap.graph import Graph, Partition

NODE_KEYS = ("id", "size", "count", "name", "group")
LINK_KEYS = ("source", "target", "value")


def full_nodes(graph: Graph) -> DataFrame:
    """One node per vertex, and an invisible one per id that keeps the group order when drawn."""
    real = graph.vertices.select(
        "id", F.lit(1.0).alias("size"), F.lit(1).cast("bigint").alias("count"), "name",
        F.col("module").alias("group"),
    )
    shadow = graph.vertices.select(
        (-F.col("id")).alias("id"), F.lit(0.0).alias("size"), F.lit(0).cast("bigint").alias("count"),
        F.lit("").alias("name"), F.col("id").alias("group"),
    )
    return real.unionByName(shadow)


def reduced_nodes(part: Partition) -> DataFrame:
    """One node per module, sized by its frequency."""
    return part.modules.select(
        F.col("module").alias("id"), F.col("p").alias("size"), F.col("n").alias("count"),
        F.col("module").cast("string").alias("name"), F.col("module").alias("group"),
    )


def links_of(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.col("weight").alias("value")
    )


def _quoted(column: str) -> Column:
    """The value as a JSON string literal, escaped by Spark's JSON writer."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _object(keys: tuple[str, ...]) -> Column:
    pieces = []
    for key in keys:
        pieces += [F.lit(f'"{key}": '), _quoted(key), F.lit(", ")]
    return F.concat(F.lit("\t\t{"), *pieces[:-1], F.lit("}"))


def _objects(table: DataFrame, keys: tuple[str, ...], order: tuple[str, str], part: int) -> DataFrame:
    """One line per row; all but the last end with a comma."""
    rows = table.select(
        F.col(order[0]).alias("k1"), F.col(order[1]).alias("k2"), _object(keys).alias("line")
    )
    last = rows.agg(F.max(F.struct("k1", "k2", "line"))).scalar()
    comma = F.when(F.struct("k1", "k2", "line") == last, F.lit("")).otherwise(F.lit(","))
    return rows.select(F.lit(part).alias("part"), "k1", "k2", F.concat("line", comma).alias("line"))


def node_link_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(part, k1, k2, line)``; sorted by all four the lines are the document.

    All values are strings.  There is no ``links`` key if there are no links.
    """
    spark = nodes.sparkSession
    any_link = links.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    zero = F.lit(0).cast("bigint")

    def frame(part: int, *lines: str) -> DataFrame:
        return spark.range(1).select(
            F.lit(part).alias("part"), zero.alias("k1"), zero.alias("k2"),
            F.lit("\n".join(lines)).alias("line"),
        )

    return (
        frame(0, "{", '\t"nodes": [')
        .unionByName(_objects(nodes, NODE_KEYS, ("id", "group"), 1))
        .unionByName(frame(2, "\t],", '\t"links": [').filter(any_link))
        .unionByName(_objects(links, LINK_KEYS, ("source", "target"), 3))
        .unionByName(frame(4, "\t]"))
        .unionByName(frame(5, "}"))
    )


def write_node_link(nodes: DataFrame, links: DataFrame, path: str) -> None:
    node_link_lines(nodes, links).orderBy("part", "k1", "k2", "line").select("line").write.text(path)
