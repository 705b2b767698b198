"""Module tables: initial partition, code length and contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymap.functions.flow_math import (
    codelength_value, exit_flow, module_term, number, plogp,
)
from eddymap.graph import Graph, Partition
from eddymap.operators.edges import drop_self_loops, split_by_module
from eddymap.operators.walk import flow_rows, iterate_walk, prepare_walk
from eddymap.store import Store

# Modules from which on their table is no longer broadcast by Spark's own limit, and is hashed in parts instead.
HASHED_MODULES = 1 << 18


def module_sums() -> dict[str, Column]:
    """The sums over a module table that the code length needs."""
    return {
        "q_sum": F.sum("q"),
        "terms": F.expr(f"sum({module_term('p', 'q')})"),
    }


def codelength(modules: DataFrame, prob_sum: float) -> float:
    """Code length of a module table."""
    return codelength_table(modules, prob_sum).first()["codelength"]


def codelength_table(modules: DataFrame, prob_sum: float) -> DataFrame:
    """The code length as a one-row table."""
    sums = {"n": F.count(F.lit(1)), **module_sums()}
    several = f"{plogp('q_sum')} + terms - {number(prob_sum)}"
    return modules.agg(*[column.alias(key) for key, column in sums.items()]).selectExpr(
        f"CASE WHEN n = 1 THEN {number(-prob_sum)} ELSE {several} END AS codelength"
    )


def init_partition(
    graph: Graph, tele: float = 0.15, err_factor: float = 20.0,
    fixed_iter: int | None = None, max_iter: int = 1000, store: Store | None = None,
) -> Partition:
    """Every vertex as its own module.

    Self-loops are dropped and the edges normalised once; the same stored links serve the walk and
    the flow table.  Out-links sum to one per source, so ``w = q = p`` wherever there are any; a
    dangling vertex has ``w = 0`` and leaves only by teleporting.
    """
    store = store or Store(graph.spark)
    walk = prepare_walk(graph.vertices, drop_self_loops(graph.edges), store)
    try:
        found = iterate_walk(walk, 1.0 - tele, err_factor, store, fixed_iter, max_iter)
        state = found.table.df.select("id", "slots", "p")
        if walk.n_nodes == 1:
            flows = ["1D AS p", "0D AS w", "0D AS q"]
        else:
            flows = ["p", "if(slots > 0, p, 0D) AS w", f"if(slots > 0, p, {number(tele)} * p) AS q"]
        modules = store.cut(
            state.selectExpr("id AS module", "1L AS n", *flows),
            "modules", prob_sum=F.expr(f"sum({plogp('p')})"), **module_sums(),
        )
        links = store.cut(flow_rows(walk, state), "links")
    finally:
        walk.close()
    found.table.drop()
    sums = modules.stats
    return Partition(
        modules=modules.df, links=links.df, n_nodes=walk.n_nodes, tele=tele,
        prob_sum=sums["prob_sum"], q_sum=sums["q_sum"],
        codelength=codelength_value(modules.rows, sums["q_sum"], sums["terms"], sums["prob_sum"]),
        n_modules=modules.rows, n_links=links.rows,
    )


def relabel_nodes(graph: Graph, module_map: DataFrame) -> Graph:
    """Move each vertex to the module that ``module_map (module, target)`` gives for its own."""
    moved = graph.vertices.join(module_map, "module", "left").select(
        "id", "name", F.coalesce("target", "module").alias("module")
    )
    return graph.with_vertices(moved)


def contract_edges(links: DataFrame, module_map: DataFrame, n_modules: int = 0) -> DataFrame:
    """Relabel both ends and sum; rows with ``src = dst`` are the flow inside a module.

    With many modules the links stream unsorted past their share of the map, which has one row per module.
    """
    hashed = n_modules >= HASHED_MODULES
    return links.sparkSession.sql(
        f"""
        SELECT {"/*+ SHUFFLE_HASH(b) */" if hashed else ""} l.src, coalesce(b.target, l.dst) AS dst, sum(l.weight) AS weight
        FROM (SELECT {"/*+ SHUFFLE_HASH(a) */" if hashed else ""} coalesce(a.target, l.src) AS src, l.dst, l.weight
              FROM {{links}} l LEFT JOIN {{map}} a ON a.module = l.src) l
        LEFT JOIN {{map}} b ON b.module = l.dst
        GROUP BY 1, 2
        """, links=links, map=module_map,
    )


def contract_modules(
    modules: DataFrame, module_map: DataFrame, contracted: DataFrame, n_nodes: int, tele: float
) -> DataFrame:
    """Sum the merged modules; flow that became internal no longer leaves."""
    return modules.sparkSession.sql(
        """
        SELECT module, n, p, w, """ + exit_flow(n_nodes, tele, "n", "p", "w") + """ AS q FROM (
            SELECT module, sum(n) AS n, sum(p) AS p, sum(w) AS w FROM (
                SELECT coalesce(t.target, m.module) AS module, m.n, m.p, m.w
                FROM {modules} m LEFT JOIN {map} t ON t.module = m.module
                UNION ALL SELECT src, 0L, 0D, -weight FROM {contracted} WHERE src = dst)
            GROUP BY module)
        """, modules=modules, map=module_map, contracted=contracted,
    )


def contract(part: Partition, module_map: DataFrame, store: Store | None = None) -> Partition:
    """The partition after merging modules as ``module_map (module, target)`` says."""
    store = store or Store(part.modules.sparkSession)
    contracted = store.cut(
        contract_edges(part.links, module_map, part.n_modules), "contracted",
        between=F.count_if(F.col("src") != F.col("dst")),
    )
    modules = store.cut(
        contract_modules(part.modules, module_map, contracted.df, part.n_nodes, part.tele),
        "modules", **module_sums(),
    )
    sums = modules.stats
    return Partition(
        modules=modules.df, links=split_by_module(contracted.df)[1], n_nodes=part.n_nodes,
        tele=part.tele, prob_sum=part.prob_sum, q_sum=sums["q_sum"],
        codelength=codelength_value(modules.rows, sums["q_sum"], sums["terms"], part.prob_sum),
        n_modules=modules.rows, n_links=contracted.stats["between"],
    )
