"""Edge-table operators: projections, out-weights and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.store import Store


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def split_by_module(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows inside one module, and rows between two modules."""
    return links.filter(F.col("src") == F.col("dst")), links.filter(F.col("src") != F.col("dst"))


def undirected_weight(edges: DataFrame) -> DataFrame:
    """One row per unordered pair ``m1 <= m2`` with the weight of both directions."""
    return (
        edges.groupBy(F.least("src", "dst").alias("m1"), F.greatest("src", "dst").alias("m2"))
        .agg(F.sum("weight").alias("weight"))
    )


def out_weight(edges: DataFrame) -> DataFrame:
    """Total weight and number of out-edges per source."""
    return edges.groupBy("src").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("degree")
    )


def normalize_edges(edges: DataFrame, store: Store | None = None) -> DataFrame:
    """Divide each weight by its source's total.

    A source whose total is 0 loses its edges.  The totals are combined on the map side and written, so
    that both sides of the join are plain shuffles and adaptive execution can split a hub source.
    """
    store = store or Store(edges.sparkSession)
    totals = store.cut(out_weight(edges).filter("total > 0").select("src", "total"), "totals").df
    return edges.join(totals, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight"))


def dangling_nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of vertices without an out-edge."""
    return vertices.select("id").join(
        edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti"
    )
