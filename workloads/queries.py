"""Every operator as a query over the whole tables; :mod:`workloads.oracles` has the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddymap import Graph, graph_from_tables, init_partition, multi_merge, pagerank, pair_merge, read_graph, run
from eddymap.operators import analysis, edges as edge_ops, merge, pairs
from eddymap.operators.components import connected_components, label_edges
from eddymap.operators.partition import (
    codelength_table, contract, contract_edges, contract_modules, relabel_nodes,
)
from eddymap.operators.walk import pagerank_step, prepare_walk, sparse_matvec, start_frequencies
from eddymap.plans.compare import compare_modes
from eddymap.plans.pipeline import detect_communities
from eddymap.sinks import (
    full_nodes, node_link_lines, reduced_nodes, vertex_lines, write_node_link, write_parquet,
)
from eddymap.sinks.node_link import links_of
from eddymap.sources import pajek_faults, read_node_link, read_pajek, read_parquet_graph, read_saved
from eddymap.store import Store
from workloads import views

Query = Callable[[SparkSession, str], DataFrame]

# Steps of the query for a fixed number of steps; all other walks run until they converge.
RANK_STEPS = 10
DIGITS = 8


# Many exact values end in a 5 just past the last digit kept; a tiny shift, the same in the SQL, keeps
# the last bit of a sum from deciding how they round.
SHIFT = 3.1e-12


def rounded(column: str | Column, digits: int = DIGITS) -> Column:
    """Round for comparison."""
    name = column if isinstance(column, str) else None
    value = F.round((F.col(column) if name else column) + F.lit(SHIFT), digits)
    return value.alias(name) if name else value


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column."""
    return df.select(*[rounded(n, digits) if t == "double" else n for n, t in df.dtypes])


def _graph(store: Store, links: DataFrame) -> Graph:
    """The graph of a link table; its sums of parallel links are written once, and all steps read those."""
    edges = store.cut(graph_from_tables(views.endpoints(links), links, strict=None).edges, "edges").df
    return replace(graph_from_tables(views.endpoints(edges), edges, strict=None), edges=edges)


def _chain(spark: SparkSession, sf_dir: str) -> tuple[Store, Graph]:
    store = Store(spark)
    # The graph sums parallel rows itself.
    return store, _graph(store, views.chain_rows(spark, sf_dir).filter("src <> dst"))


def _started(spark: SparkSession, sf_dir: str):
    store, graph = _chain(spark, sf_dir)
    return store, graph, init_partition(graph, store=store)


def _first_round(spark: SparkSession, sf_dir: str):
    """State, merges and map of the first symmetric round."""
    store, graph, part = _started(spark, sf_dir)
    merges = merge.choose_merges(part, "symmetric", store)
    return store, graph, part, merge.module_map(merges.df, store, merges.rows).df


def _contracted(spark: SparkSession, sf_dir: str):
    store, graph, part, moved = _first_round(spark, sf_dir)
    return store, relabel_nodes(graph, moved), contract(part, moved, store)


# --- projections and aggregates on the raw chain -------------------------------------------------

def drop_self_loops(spark, sf_dir):
    return edge_ops.drop_self_loops(views.chain_rows(spark, sf_dir))


def reverse_edges(spark, sf_dir):
    return edge_ops.reverse_edges(views.chain_rows(spark, sf_dir))


def out_weight(spark, sf_dir):
    return edge_ops.out_weight(views.chain_rows(spark, sf_dir))


def undirected_weight(spark, sf_dir):
    return edge_ops.undirected_weight(views.chain_rows(spark, sf_dir))


def parallel_edge_sum(spark, sf_dir):
    rows = views.chain_rows(spark, sf_dir)
    ends = views.endpoints(rows)
    return graph_from_tables(ends, rows, strict=None).edges


def normalize_edges(spark, sf_dir):
    return tidy(edge_ops.normalize_edges(views.chain_links(spark, sf_dir)))


# --- walks ---------------------------------------------------------------------------------------

def _bipartite(spark, sf_dir):
    store = Store(spark)
    return store, _graph(store, views.customer_supplier(spark, sf_dir))


def dangling_nodes(spark, sf_dir):
    _, graph = _bipartite(spark, sf_dir)
    return edge_ops.dangling_nodes(graph.vertices, graph.edges)


def sparse_matvec_query(spark, sf_dir):
    _, graph = _bipartite(spark, sf_dir)
    vector = graph.vertices.select("id", (F.lit(1.0) / (F.col("id") + 1)).alias("x"))
    constant = edge_ops.dangling_nodes(graph.vertices, graph.edges).withColumn("c", F.lit(0.001))
    return tidy(sparse_matvec(edge_ops.normalize_edges(graph.edges), constant, vector))


def pagerank_step_query(spark, sf_dir):
    store, graph = _bipartite(spark, sf_dir)
    walk = prepare_walk(graph.vertices, graph.edges, store)
    mass = walk.n_dangling / walk.n_nodes
    return tidy(pagerank_step(walk, start_frequencies(walk), mass, 0.85).select("id", "p"), 10)


def pagerank_10(spark, sf_dir):
    store, graph = _chain(spark, sf_dir)
    return tidy(pagerank(graph, 0.85, fixed_iter=RANK_STEPS, store=store), 10)


def pagerank_converged(spark, sf_dir):
    store, graph = _chain(spark, sf_dir)
    return tidy(pagerank(graph, 0.85, 20.0, store=store), 10)


# --- modules -------------------------------------------------------------------------------------

def init_modules(spark, sf_dir):
    return tidy(_started(spark, sf_dir)[2].modules, 10)


def init_flow_edges(spark, sf_dir):
    return tidy(_started(spark, sf_dir)[2].links, 10)


def codelength_init(spark, sf_dir):
    _, _, part = _started(spark, sf_dir)
    return codelength_table(part.modules, part.prob_sum).select(
        rounded("codelength"), rounded(F.lit(part.prob_sum)).alias("prob_sum"),
        rounded(F.lit(part.q_sum)).alias("q_sum"),
    )


def delta_table(spark, sf_dir):
    return tidy(merge.delta_table(_started(spark, sf_dir)[2]))


def symmetric_deltas(spark, sf_dir):
    return tidy(merge.symmetric_deltas(_started(spark, sf_dir)[2]))


def choose_merges_sym(spark, sf_dir):
    store, _, part = _started(spark, sf_dir)
    return merge.choose_merges(part, "symmetric", store).df


def choose_merges_asym(spark, sf_dir):
    store, _, part = _started(spark, sf_dir)
    return merge.choose_merges(part, "asymmetric", store).df


def connected_components_query(spark, sf_dir):
    store, graph = _chain(spark, sf_dir)
    return connected_components(graph.edges, store).df


def label_edges_query(spark, sf_dir):
    store, graph = _chain(spark, sf_dir)
    return label_edges(graph.edges, store)


def module_map_1(spark, sf_dir):
    return _first_round(spark, sf_dir)[3]


def relabel_1(spark, sf_dir):
    _, graph, _, moved = _first_round(spark, sf_dir)
    return relabel_nodes(graph, moved).vertices.select("id", "module")


def contract_edges_1(spark, sf_dir):
    _, _, part, moved = _first_round(spark, sf_dir)
    return tidy(contract_edges(part.links, moved, part.n_modules), 10)


def contract_modules_1(spark, sf_dir):
    _, _, part, moved = _first_round(spark, sf_dir)
    inside = contract_edges(part.links, moved, part.n_modules)
    return tidy(contract_modules(part.modules, moved, inside, part.n_nodes, part.tele), 10)


def codelength_1(spark, sf_dir):
    _, _, part = _contracted(spark, sf_dir)
    return tidy(codelength_table(part.modules, part.prob_sum))


# --- searches ------------------------------------------------------------------------------------

def _searched(spark, sf_dir, direction):
    store, graph, part = _started(spark, sf_dir)
    return multi_merge(graph, part, direction, store=store)


def multi_merge_sym(spark, sf_dir):
    return _searched(spark, sf_dir, "symmetric").graph.vertices.select("id", "module")


def multi_merge_asym(spark, sf_dir):
    return _searched(spark, sf_dir, "asymmetric").graph.vertices.select("id", "module")


def merge_trace(spark, sf_dir):
    return tidy(_searched(spark, sf_dir, "symmetric").trace)


def _nations(spark, sf_dir):
    store = Store(spark)
    graph = _graph(store, views.nation_flow(spark, sf_dir))
    return store, graph, init_partition(graph, store=store)


def candidate_pairs(spark, sf_dir):
    return tidy(pairs.candidate_table(_started(spark, sf_dir)[2]))


def best_pair(spark, sf_dir):
    return tidy(pairs.best_merge(pairs.candidate_table(_started(spark, sf_dir)[2])))


def _one_merge(spark, sf_dir):
    store, graph, part = _nations(spark, sf_dir)
    table = store.cut(pairs.candidate_table(part), "candidates", best=pairs.best_merge_metric())
    return graph, part, table.df, table.stats["best"]


def update_candidates_1(spark, sf_dir):
    _, part, table, best = _one_merge(spark, sf_dir)
    return tidy(pairs.update_candidates(table, pairs.merged_scalars(part, best), best))


def apply_pair_modules_1(spark, sf_dir):
    _, part, _, best = _one_merge(spark, sf_dir)
    return tidy(pairs.apply_pair(part, best).modules)


def apply_pair_links_1(spark, sf_dir):
    _, part, _, best = _one_merge(spark, sf_dir)
    return tidy(pairs.apply_pair(part, best).links)


def relabel_pair_1(spark, sf_dir):
    graph, _, _, best = _one_merge(spark, sf_dir)
    return pairs.relabel_pair(graph, best).vertices.select("id", "module")


def pair_merge_nation(spark, sf_dir):
    store, graph, part = _nations(spark, sf_dir)
    return tidy(pair_merge(graph, part, store=store).trace)


def pair_merge_modules(spark, sf_dir):
    store, graph, part = _nations(spark, sf_dir)
    found = detect_communities(graph, part, mode="pair", store=store)
    return found.graph.vertices.select("id", "module")


def snapshots(spark, sf_dir):
    """Modules of every nation after each merge, as the search hands them out."""
    store, graph, part = _nations(spark, sf_dir)
    seen = []

    def keep(number, state, _):
        seen.append(store.cut(state.vertices.select(F.lit(number).alias("merges"), "id", "module"), "snapshot").df)
    pair_merge(graph, part, on_round=keep, store=store)
    return reduce(DataFrame.unionByName, seen)


def _ran(spark, sf_dir):
    """The whole run with every output; returns where they are."""
    store, graph = _chain(spark, sf_dir)
    stem = f"{store.folder}/run"
    run(graph, outputs={
        "parquet": f"{stem}.parquet", "text": f"{stem}.csv", "vertices": f"{stem}-names.txt",
        "reduced_json": f"{stem}-reduced.json"})
    return stem


def run_vertices(spark, sf_dir):
    return spark.read.parquet(f"{_ran(spark, sf_dir)}-graph-vertices.parquet")


def run_text_modules(spark, sf_dir):
    path = f"{_ran(spark, sf_dir)}-part-vertices.csv"
    return tidy(spark.read.schema("module bigint, n bigint, p double, w double, q double").csv(path))


def run_reduced_json(spark, sf_dir):
    return tidy(read_node_link(spark, f"{_ran(spark, sf_dir)}-reduced.json")[0])


# --- statistics of a result ----------------------------------------------------------------------

def component_sizes(spark, sf_dir):
    store, _, part = _contracted(spark, sf_dir)
    return analysis.component_sizes(part.modules, part.links, store)


def module_stats(spark, sf_dir):
    store, _, part = _contracted(spark, sf_dir)
    return tidy(analysis.module_stats(part.modules, part.links, store))


def degree(spark, sf_dir):
    _, _, part = _contracted(spark, sf_dir)
    return analysis.degrees(part.modules, part.links)


def histogram(spark, sf_dir):
    _, _, part = _contracted(spark, sf_dir)
    return tidy(analysis.histogram(part.modules, "n"))


def histogram_above(spark, sf_dir):
    _, _, part = _contracted(spark, sf_dir)
    return tidy(analysis.histogram(part.modules, "p", above=1.0 / part.n_modules))


def induced_subgraph(spark, sf_dir):
    _, _, part = _contracted(spark, sf_dir)
    significant = analysis.is_significant(analysis.expected_share(part.modules))
    kept, inside = analysis.induced_subgraph(part.modules, part.links, significant)
    return analysis.degrees(kept, inside)


def _induced(spark, sf_dir, predicate):
    _, _, part = _contracted(spark, sf_dir)
    kept, inside = analysis.induced_subgraph(part.modules, part.links, predicate(part))
    return analysis.degrees(kept, inside)


def induced_small(spark, sf_dir):
    return _induced(spark, sf_dir, lambda part: analysis.is_small(analysis.expected_share(part.modules)))


def induced_singletons(spark, sf_dir):
    return _induced(spark, sf_dir, lambda part: analysis.is_singleton())


def induced_large(spark, sf_dir):
    return _induced(spark, sf_dir, lambda part: F.col("p") > F.lit(0.001))


# --- graphs with many components, and with directed blocks ---------------------------------------

def _runs(spark, sf_dir):
    """The forest of order runs; an order without a near successor or predecessor stands alone."""
    store = Store(spark)
    everyone = views.table(spark, sf_dir, "orders").select("o_orderkey")
    graph = graph_from_tables(everyone, views.order_runs(spark, sf_dir), strict=None)
    return store, replace(graph, edges=store.cut(graph.edges, "edges").df)


def _markets(spark, sf_dir, abroad=0.0):
    store = Store(spark)
    graph = _graph(store, views.market_links(spark, sf_dir, abroad))
    return store, graph, init_partition(graph, store=store)


def run_components(spark, sf_dir):
    store, graph = _runs(spark, sf_dir)
    return connected_components(graph.edges, store).df


def run_label_edges(spark, sf_dir):
    store, graph = _runs(spark, sf_dir)
    return label_edges(graph.edges, store)


def run_component_sizes(spark, sf_dir):
    """Orders per run, single orders included."""
    store, graph = _runs(spark, sf_dir)
    part = init_partition(graph, store=store)
    return analysis.component_sizes(part.modules, part.links, store)


def run_singletons(spark, sf_dir):
    """Orders that are a module of their own after the first round."""
    store, graph = _runs(spark, sf_dir)
    part = init_partition(graph, store=store)
    merges = merge.choose_merges(part, "symmetric", store)
    part = contract(part, merge.module_map(merges.df, store, merges.rows).df, store)
    kept, inside = analysis.induced_subgraph(part.modules, part.links, analysis.is_singleton())
    return analysis.degrees(kept, inside)


def _markets_contracted(spark, sf_dir):
    store, graph, part = _markets(spark, sf_dir)
    merges = merge.choose_merges(part, "symmetric", store)
    return store, contract(part, merge.module_map(merges.df, store, merges.rows).df, store)


def market_component_sizes(spark, sf_dir):
    store, part = _markets_contracted(spark, sf_dir)
    return analysis.component_sizes(part.modules, part.links, store)


def market_module_stats(spark, sf_dir):
    store, part = _markets_contracted(spark, sf_dir)
    return tidy(analysis.module_stats(part.modules, part.links, store))


# What a link to the next order of the nation weighs, beside 20 inside a market.
ABROAD = 1.0


def _market_search(spark, sf_dir, direction):
    store, graph, part = _markets(spark, sf_dir, ABROAD)
    return multi_merge(graph, part, direction, store=store)


def market_merge_asym(spark, sf_dir):
    return _market_search(spark, sf_dir, "asymmetric").graph.vertices.select("id", "module")


def market_trace_asym(spark, sf_dir):
    return tidy(_market_search(spark, sf_dir, "asymmetric").trace)


def market_trace_sym(spark, sf_dir):
    return tidy(_market_search(spark, sf_dir, "symmetric").trace)


# --- sinks and sources ---------------------------------------------------------------------------

def full_json_nodes(spark, sf_dir):
    _, graph = _chain(spark, sf_dir)
    return full_nodes(graph)


def reduced_json_nodes(spark, sf_dir):
    return tidy(reduced_nodes(_contracted(spark, sf_dir)[2]), 10)


def vertex_listing(spark, sf_dir):
    """Customers as the aligned text table."""
    names = views.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    nothing = spark.createDataFrame([], "src bigint, dst bigint, weight double")
    return vertex_lines(graph_from_tables(names, nothing, strict=None)).select("line")


def full_json_lines(spark, sf_dir):
    store = Store(spark)
    graph = _graph(store, views.nation_flow(spark, sf_dir))
    return node_link_lines(full_nodes(graph), links_of(graph.edges)).select(
        F.explode(F.split("line", "\n")).alias("line")
    )


def json_round_trip(spark, sf_dir):
    """The first state's modules written as a node-link document and read back."""
    store, _, part = _started(spark, sf_dir)
    path = f"{store.folder}/modules.json"
    write_node_link(reduced_nodes(part), links_of(part.links), path)
    return tidy(read_node_link(spark, path)[1], 10)


def pajek_round_trip(spark, sf_dir):
    """Edges and named vertices laid out as Pajek text, and read back."""
    store = Store(spark)
    people = views.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("c_custkey"), "c_name"
    )
    count = people.agg(F.max("c_custkey").alias("n")).scalar()
    bought = views.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 1).alias("o_custkey"), "o_orderpriority",
        (F.pmod(F.col("o_orderkey"), F.lit(1000)) / 8).alias("weight"),
    )

    def line(part, key, text):
        return F.lit(part).alias("part"), key.alias("key"), text.alias("value")

    def heading(part, text):
        return spark.range(1).select(*line(part, F.lit(0).cast("bigint"), text))

    lines = (
        heading(0, F.concat(F.lit("*Vertices "), count.cast("string")))
        .unionByName(people.select(*line(1, F.col("c_custkey"), F.concat(
            F.lit(" "), F.col("c_custkey"), F.lit(' "'), F.col("c_name"), F.lit('" x')))))
        .unionByName(heading(2, F.lit("*Arcs")))
        .unionByName(bought.select(*line(3, F.col("o_custkey"), F.concat_ws(
            " ", F.col("o_custkey").cast("string"),
            F.length("o_orderpriority").cast("string"), F.col("weight").cast("string")))))
    )
    path = f"{store.folder}/people.net"
    lines.orderBy("part", "key").select("value").write.text(path)
    graph = read_pajek(spark, path)
    return tidy(graph.edges.join(graph.vertices.select(F.col("id").alias("src"), "name"), "src"))


def parquet_round_trip(spark, sf_dir):
    """A graph saved as Parquet tables and read back through its manifest."""
    store, graph, part = _started(spark, sf_dir)
    stem = f"{store.folder}/saved"
    write_parquet(graph, part, stem)
    manifest = f"{stem}-manifest"
    spark.range(1).select(F.to_json(F.struct(
        F.lit(f"{stem}-graph-vertices").alias("Vertex File"),
        F.lit(f"{stem}-graph-edges").alias("Edge File"),
    ))).write.text(manifest)
    return tidy(read_parquet_graph(spark, manifest).edges)


def json_round_trip_nodes(spark, sf_dir):
    store, _, part = _started(spark, sf_dir)
    path = f"{store.folder}/modules.json"
    write_node_link(reduced_nodes(part), links_of(part.links), path)
    return tidy(read_node_link(spark, path)[0], 10)


def _pajek(spark, sf_dir):
    """Orders as list sections, most vertices undeclared, read from text."""
    store = Store(spark)
    orders = views.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 1).alias("src"), (F.pmod(F.col("o_orderkey"), F.lit(97)) + 1).alias("dst"))
    count = orders.agg(F.max(F.greatest("src", "dst"))).scalar()
    named = views.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), "n_name")
    one = spark.range(1)
    lines = (
        one.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("key"), F.concat(F.lit("*vertices "), count.cast("string")).alias("value"))
        .unionByName(named.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.col("id"), F.lit(' "'), "n_name", F.lit('"')).alias("value")))
        .unionByName(one.select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("key"), F.lit("*Arcslist").alias("value")))
        .unionByName(orders.select(F.lit(3).alias("part"), F.col("src").alias("key"), F.concat_ws(" ", "src", "dst", F.lit(1)).alias("value")))
    )
    path = f"{store.folder}/lists.net"
    lines.orderBy("part", "key").select("value").write.text(path)
    return read_graph(spark, path)


def pajek_lists(spark, sf_dir):
    return _pajek(spark, sf_dir).edges


def pajek_implicit_vertices(spark, sf_dir):
    return _pajek(spark, sf_dir).vertices


def parquet_round_trip_vertices(spark, sf_dir):
    store, graph, part = _started(spark, sf_dir)
    stem = f"{store.folder}/saved"
    write_parquet(graph, part, stem)
    return spark.read.parquet(f"{stem}-graph-vertices")


def parquet_manifest_vertices(spark, sf_dir):
    """Vertices of a saved graph, read through its manifest."""
    store, graph, part = _nations(spark, sf_dir)
    stem = f"{store.folder}/saved"
    write_parquet(graph, part, stem)
    spark.range(1).select(F.to_json(F.struct(
        F.lit(f"{stem}-graph-vertices").alias("Vertex File"), F.lit(f"{stem}-graph-edges").alias("Edge File"),
    ))).write.text(f"{stem}-manifest")
    return read_parquet_graph(spark, f"{stem}-manifest").vertices


# Vertices that the faulty file declares; customers beyond are out of range.
DECLARED = 1000


def pajek_faults_query(spark, sf_dir):
    """All faults of a file whose vertices repeat and whose arcs leave the range, fall below 0 or do not parse."""
    store = Store(spark)
    zero = F.lit(0).cast("bigint")
    named = lambda df, key, name: df.select(
        F.col(key).cast("bigint").alias("key"), F.concat(F.col(key) + 1, F.lit(' "'), F.col(name), F.lit('"')).alias("value"))
    weight = F.when(F.col("o_orderkey") % 500 == 7, F.lit("x")).otherwise((F.col("o_orderkey") % 1000 - 5).cast("string"))
    one = spark.range(1)
    parts = [
        one.select(zero.alias("key"), F.lit(f"*Vertices {DECLARED}").alias("value")),
        named(views.table(spark, sf_dir, "customer"), "c_custkey", "c_name"),
        named(views.table(spark, sf_dir, "nation"), "n_nationkey", "n_name"),
        one.select(zero.alias("key"), F.lit("*Arcs").alias("value")),
        views.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("key"),
            F.concat_ws(" ", F.col("o_custkey") + 1, F.col("o_orderkey") % 97 + 1, weight).alias("value")),
    ]
    lines = reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(i)) for i, df in enumerate(parts)])
    path = f"{store.folder}/faulty.net"
    lines.orderBy("part", "key").select("value").write.text(path)
    return pajek_faults(spark, path, store)


def _saved_states(spark, sf_dir, kind):
    """The state after the first round of a run with every state saved, read back."""
    store = Store(spark)
    graph = _graph(store, views.market_links(spark, sf_dir, ABROAD))
    path = f"{store.folder}/states.{kind}"
    run(graph, outputs={kind: path}, debug=True, strict=None)
    return read_saved(spark, path, kind, suffix="1")


def saved_state_modules(spark, sf_dir):
    return tidy(_saved_states(spark, sf_dir, "parquet")[1].modules)


def saved_state_links(spark, sf_dir):
    return tidy(_saved_states(spark, sf_dir, "text")[1].links)


def saved_state_vertices(spark, sf_dir):
    return _saved_states(spark, sf_dir, "text")[0].vertices


def compare_modes_query(spark, sf_dir):
    """All three searches on the flow between nations; the measured seconds are left out."""
    store, graph, part = _nations(spark, sf_dir)
    return tidy(compare_modes(graph, part, store=store).drop("seconds"))


QUERIES: dict[str, Query] = {
    "drop_self_loops": drop_self_loops,
    "reverse_edges": reverse_edges,
    "out_weight": out_weight,
    "undirected_weight": undirected_weight,
    "parallel_edge_sum": parallel_edge_sum,
    "normalize_edges": normalize_edges,
    "dangling_nodes": dangling_nodes,
    "sparse_matvec": sparse_matvec_query,
    "pagerank_step": pagerank_step_query,
    "pagerank_10": pagerank_10,
    "pagerank_converged": pagerank_converged,
    "init_modules": init_modules,
    "init_flow_edges": init_flow_edges,
    "codelength_init": codelength_init,
    "delta_table": delta_table,
    "symmetric_deltas": symmetric_deltas,
    "choose_merges_sym": choose_merges_sym,
    "choose_merges_asym": choose_merges_asym,
    "connected_components": connected_components_query,
    "label_edges": label_edges_query,
    "module_map_1": module_map_1,
    "relabel_1": relabel_1,
    "contract_edges_1": contract_edges_1,
    "contract_modules_1": contract_modules_1,
    "codelength_1": codelength_1,
    "multi_merge_sym": multi_merge_sym,
    "multi_merge_asym": multi_merge_asym,
    "merge_trace": merge_trace,
    "candidate_pairs": candidate_pairs,
    "best_pair": best_pair,
    "update_candidates_1": update_candidates_1,
    "apply_pair_modules_1": apply_pair_modules_1,
    "apply_pair_links_1": apply_pair_links_1,
    "relabel_pair_1": relabel_pair_1,
    "pair_merge_nation": pair_merge_nation,
    "component_sizes": component_sizes,
    "module_stats": module_stats,
    "degree": degree,
    "histogram": histogram,
    "histogram_above": histogram_above,
    "induced_subgraph": induced_subgraph,
    "full_json_nodes": full_json_nodes,
    "reduced_json_nodes": reduced_json_nodes,
    "vertex_listing": vertex_listing,
    "full_json_lines": full_json_lines,
    "json_round_trip": json_round_trip,
    "pajek_round_trip": pajek_round_trip,
    "parquet_round_trip": parquet_round_trip,
    "pair_merge_modules": pair_merge_modules,
    "snapshots": snapshots,
    "run_vertices": run_vertices,
    "run_text_modules": run_text_modules,
    "run_reduced_json": run_reduced_json,
    "induced_small": induced_small,
    "induced_singletons": induced_singletons,
    "induced_large": induced_large,
    "json_round_trip_nodes": json_round_trip_nodes,
    "parquet_round_trip_vertices": parquet_round_trip_vertices,
    "pajek_lists": pajek_lists,
    "pajek_implicit_vertices": pajek_implicit_vertices,
    "pajek_faults": pajek_faults_query,
    "compare_modes": compare_modes_query,
    **{f.__name__: f for f in (
        parquet_manifest_vertices, saved_state_modules, saved_state_links, saved_state_vertices,
        run_components, run_label_edges, run_component_sizes, run_singletons, market_component_sizes,
        market_module_stats, market_merge_asym, market_trace_asym, market_trace_sym)},
}
