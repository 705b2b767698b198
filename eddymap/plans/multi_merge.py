"""Search with many merges per round."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymap.graph import TRACE_SCHEMA, Graph, Partition
from eddymap.operators.merge import TIE_TOLERANCE, choose_merges, module_map
from eddymap.operators.partition import contract, relabel_nodes
from eddymap.store import Store, Written

OnRound = Callable[[int, Graph, Partition], None]


@dataclass(frozen=True)
class Communities:
    """Graph with final modules, final partition and one trace row per state."""

    graph: Graph
    part: Partition
    trace_rows: list[tuple]

    @property
    def trace(self) -> DataFrame:
        """``(round, modules, links, codelength, delta)``."""
        return self.graph.spark.createDataFrame(self.trace_rows, TRACE_SCHEMA)


def trace_row(round_no: int, part: Partition, before: Partition | None) -> tuple:
    delta = 0.0 if before is None else part.codelength - before.codelength
    return (round_no, part.n_modules, part.n_links, part.codelength, delta)


def compose_maps(maps: list[Written], store: Store) -> Written:
    """One map ``(module, target)`` for several, applied in turn; the several are dropped.

    A module that a later map moves was not moved by an earlier one, so its row is taken over.  Maps get
    shorter from round to round, so all joins together move about as many rows as the first map has.
    """
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        onward = whole.df.select(F.col("module").alias("target"), F.col("target").alias("onward"))
        led = earlier.df.join(onward, "target", "left").select("module", F.coalesce("onward", "target").alias("target"))
        later, whole = whole, store.cut(led.unionByName(whole.df), "composed-map")
        later.drop()
        earlier.drop()
    return whole


def _moved(graph: Graph, maps: list[Written], store: Store) -> Graph:
    return relabel_nodes(graph, compose_maps(maps, store).df) if maps else graph


def multi_merge(
    graph: Graph, part: Partition, direction: str = "symmetric",
    tie_tol: float = TIE_TOLERANCE, max_rounds: int = 1000,
    on_round: OnRound | None = None, store: Store | None = None,
) -> Communities:
    """Merge each module with its best neighbour, all at once, while the code length falls.

    A round whose code length does not fall is rejected and the state before it returned.  The
    rounds work on the module tables alone; their maps are composed at the end, from the last to the
    first, and the vertex table is joined once with what they make together.
    """
    store = store or Store(graph.spark)
    trace = [trace_row(0, part, None)]
    held: list[Written] = []  # tables of the current state that the search wrote itself
    maps: list[Written] = []
    first = graph
    for round_no in range(max_rounds):
        if on_round:
            on_round(round_no, graph, part)
        start = store.mark()
        merges = choose_merges(part, direction, store, tie_tol)
        if merges.rows == 0:
            merges.drop()
            return Communities(_moved(first, maps, store), part, trace)
        moved = module_map(merges.df, store, merges.rows)
        merges.drop()
        after = contract(part, moved.df, store)
        if after.codelength >= part.codelength:
            store.drop_since(start)
            return Communities(_moved(first, maps, store), part, trace)
        maps.append(moved)
        if on_round:
            graph = relabel_nodes(graph, moved.df)
        trace.append(trace_row(round_no + 1, after, part))
        part = after
        for table in held:
            table.drop()
        held = [table for table in store.written_since(start) if table.path != moved.path]
    raise RuntimeError(f"merging did not end within {max_rounds} rounds")
