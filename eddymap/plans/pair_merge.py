"""Search with one merge per round: sequential by definition, for small or reduced graphs."""

from __future__ import annotations

from dataclasses import replace

from eddymap.graph import Graph, Partition
from eddymap.operators.merge import module_map
from eddymap.operators.pairs import FOLD_EVERY, CandidateIndex, apply_pair, merged_scalars, relabel_pair
from eddymap.operators.partition import contract, relabel_nodes
from eddymap.plans.multi_merge import Communities, OnRound, trace_row
from eddymap.store import Store


def pair_merge(
    graph: Graph, part: Partition, max_merges: int | None = None,
    on_round: OnRound | None = None, store: Store | None = None, fold_every: int = FOLD_EVERY,
) -> Communities:
    """Merge the pair with the smallest ``dl`` until none is left or the best is above 0.

    One job per merge: appending the changed candidates also finds the next best pair.  The
    module and vertex tables are brought up to date once at the end, from the list of merges, unless
    ``on_round`` asks for every state.
    """
    store = store or Store(graph.spark)
    trace = [trace_row(0, part, None)]
    start_graph, start = graph, part
    merged: list[tuple[int, int]] = []
    index = CandidateIndex.start(part, store, fold_every)
    while True:
        if on_round:
            on_round(len(merged), graph, part)
        best = index.best
        if best is None or best.dl > 0 or len(merged) == max_merges:
            break
        before, part = part, merged_scalars(part, best)
        if on_round:
            tables = apply_pair(before, best)
            modules = store.cut(tables.modules, "modules")
            links = store.cut(tables.links, "links")
            part = replace(tables, modules=modules.df, links=links.df, n_links=links.rows)
            graph = relabel_pair(graph, best)
        merged.append((best.m2, best.m1))
        index.apply(part, best)
        trace.append(trace_row(len(merged), part, before))
    index.close()
    if merged and not on_round:
        pairs = graph.spark.createDataFrame(merged, "src bigint, dst bigint")
        moved = module_map(pairs, store)
        final = contract(start, moved.df, store)
        graph = relabel_nodes(start_graph, moved.df)
        part = replace(final, codelength=part.codelength, q_sum=part.q_sum)
    return Communities(graph, part, trace)
