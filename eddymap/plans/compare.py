"""The searches side by side on one graph."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eddymap.graph import Graph, Partition
from eddymap.plans.pipeline import detect_communities
from eddymap.store import Store

COMPARE_SCHEMA = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("rounds", T.IntegerType()),
    T.StructField("modules", T.LongType()),
    T.StructField("codelength", T.DoubleType()),
    T.StructField("above_best", T.DoubleType()),
    T.StructField("seconds", T.DoubleType()),
])
MODES = ("pair", "symmetric", "asymmetric")


def compare_modes(
    graph: Graph, part: Partition, modes: tuple[str, ...] = MODES, store: Store | None = None
) -> DataFrame:
    """One row per search: rounds taken, modules left, code length, by what share it is above the shortest
    one, and seconds.

    ``pair`` merges one pair per round, the others many; all start from the same partition.
    """
    store = store or Store(graph.spark)
    rows = []
    for mode in modes:
        start = time.perf_counter()
        how = ("pair", "symmetric") if mode == "pair" else ("multi", mode)
        found = detect_communities(graph, part, *how, store=store)
        last = found.trace_rows[-1]
        rows.append((mode, last[0], last[1], last[3], time.perf_counter() - start))
    best = min(row[3] for row in rows)
    return graph.spark.createDataFrame(
        [(*row[:4], row[3] / best - 1.0 if best > 0 else 0.0, row[4]) for row in rows], COMPARE_SCHEMA)
