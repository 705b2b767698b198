"""From a graph to communities in one call."""

from __future__ import annotations

from eddymap.graph import Graph, Partition, check_endpoints, without_stray_edges
from eddymap.operators.partition import init_partition
from eddymap.plans.multi_merge import Communities, multi_merge
from eddymap.plans.pair_merge import pair_merge
from eddymap.store import Store


def detect_communities(
    graph: Graph, part: Partition, mode: str = "multi", direction: str = "symmetric",
    store: Store | None = None, **options,
) -> Communities:
    """Search with the named mode, ``multi`` or ``pair``."""
    if mode == "multi":
        return multi_merge(graph, part, direction, store=store, **options)
    if mode == "pair":
        return pair_merge(graph, part, store=store, **options)
    raise ValueError(f"unknown mode {mode!r}: use 'multi' or 'pair'")


def run(
    source, tele: float = 0.15, err_factor: float = 20.0, mode: str = "multi",
    direction: str = "symmetric", outputs: dict[str, str] | None = None, debug: bool = False,
    spark=None, strict: bool | None = True, max_iter: int = 1000, **limits,
) -> Communities:
    """Read (a path or a :class:`Graph`), initialise, search, and save to ``outputs``.

    With ``debug`` every state is saved as well, its number put before the extension.  An edge that
    leaves the vertex table raises (``strict=True``), is dropped (``False``) or is let pass (``None``).
    ``max_iter`` bounds the walk; further keywords (``tie_tol``, ``max_rounds``, ``max_merges``) go to the
    search of the mode that knows them.
    """
    from eddymap.sinks.save import save
    from eddymap.sources.dispatch import read_graph

    graph = source if isinstance(source, Graph) else read_graph(spark, source)
    store = Store(graph.spark)
    graph = Graph(graph.vertices, store.cut(graph.edges, "edges").df)  # sums of parallel edges, once
    if strict:
        check_endpoints(graph)
    elif strict is False:
        graph = without_stray_edges(graph)
    part = init_partition(graph, tele, err_factor, max_iter=max_iter, store=store)
    on_round = None
    if debug and outputs:
        def on_round(number, state_graph, state_part):
            save(state_graph, state_part, outputs, suffix=str(number))
    found = detect_communities(graph, part, mode, direction, store, on_round=on_round, **limits)
    if outputs:
        save(found.graph, found.part, outputs)
    return found
