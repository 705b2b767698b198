"""Single operators against brute force and literal expectations."""

import math
import os
import random

import pytest
from helpers import rows

from eddymap import Graph, graph_from_tables, init_partition, multi_merge, pagerank
from eddymap.functions.flow_math import plogp_value
from eddymap.graph import EDGE_SCHEMA, VERTEX_SCHEMA
from eddymap.operators import analysis, merge, pairs, walk
from eddymap.operators.components import connected_components, label_edges
from eddymap.operators.partition import HASHED_MODULES, codelength, contract, contract_edges
from eddymap.operators.walk import sparse_matvec
from eddymap.store import FILE_CLEANUP, Store

def smallest_ids(edges):
    """Brute force: repeat until no label falls."""
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def component_cases():
    """Cycles, stars, paths, forests and self-loops of several sizes, ids on both sides of zero."""
    rng = random.Random(31)
    for size in (1, 2, 3, 6, 11):
        ids = rng.sample(range(-60, 60), size + 1)
        yield list(zip(ids, ids[1:] + ids[:1]))  # a cycle
        yield [(ids[0], x) if k % 2 else (x, ids[0]) for k, x in enumerate(ids[1:])]  # a star
        yield [(x, x) for x in ids]  # self-loops only
        yield [(ids[k], ids[rng.randrange(k)]) for k in range(1, size + 1) if k % 4]  # a forest
        path = list(zip(ids, ids[1:]))
        yield path + path[:1] + [(b, a) for a, b in path]  # a path both ways, one edge twice


def test_component_cases(spark):
    """All cases at once, each moved to its own id range."""
    edges, expected = [], []
    for number, case in enumerate(component_cases()):
        moved = [(a + 1000 * number, b + 1000 * number) for a, b in case]
        label = smallest_ids(moved)
        edges += moved
        expected += [(a, b, label[a]) for a, b in moved]
    found = label_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert rows(found) == sorted(expected)


def test_no_edges(spark):
    with pytest.raises(ValueError, match="empty edge table"):
        label_edges(spark.createDataFrame([], "src bigint, dst bigint"))


def test_components_of_long_chain_star_and_random(spark):
    rng = random.Random(7)
    chain = list(range(300))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:]))
    edges += [(1000 + 13, 1000 + k) for k in range(1, 200)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)]
    found = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert dict(rows(found.df)) == smallest_ids(edges)


@pytest.mark.parametrize("size,filled,constants", [(1, 0, 1), (3, 4, 0), (5, 9, 2), (9, 30, 1)])
def test_matrix_times_vector(spark, size, filled, constants):
    """Random sparse matrices, some columns constant, against the dense product."""
    rng = random.Random(size)
    dense = [[0.0] * size for _ in range(size)]
    flat = dict((c, rng.randrange(1, 9) / 8) for c in rng.sample(range(size), constants))
    cells = [(r, c) for r in range(size) for c in range(size) if c not in flat]
    for r, c in rng.sample(cells, min(filled, len(cells))):
        dense[r][c] = rng.randrange(-16, 17) / 4
    vector = [rng.randrange(-20, 21) / 2 for _ in range(size)]
    entries = [(c, r, dense[r][c]) for r, c in cells if dense[r][c]]
    found = sparse_matvec(
        spark.createDataFrame(entries, EDGE_SCHEMA),
        spark.createDataFrame(list(flat.items()), "id bigint, c double"),
        spark.createDataFrame(list(enumerate(vector)), "id bigint, x double"),
    )
    everywhere = sum(value * vector[c] for c, value in flat.items())
    product = [sum(a * x for a, x in zip(row, vector)) + everywhere for row in dense]
    assert rows(found) == list(enumerate(product))


@pytest.mark.parametrize("name,damping,expected", [
    ("arrow-loop", 1.0, [0.0, 1.0]),
    ("arrow-loop", 0.85, [0.075, 0.925]),
    ("arrow", 1.0, [0.328125, 0.671875]),
    ("arrow", 0.85, [0.3557423828, 0.6442576172]),
    ("one", 0.85, [1.0]),
    ("pair-and-one", 0.85, [0.4642670010, 0.4642670010, 0.0714659979]),
])
def test_pagerank(net, name, damping, expected):
    found = [p for _, p in rows(pagerank(net(name), damping))]
    assert found == pytest.approx(expected, abs=1e-9)
    assert sum(found) == pytest.approx(1.0)


def test_walk_limit(net):
    with pytest.raises(RuntimeError, match="did not converge"):
        pagerank(net("two-fans"), 0.85, err_factor=1e9, max_iter=2)


def test_busy_source_is_spread(spark, monkeypatch):
    """A hub with a third of all edges gives the same frequencies when spread over slots."""
    edges = [(0, k, 1.0 + k % 3) for k in range(1, 40)]
    edges += [(k, (k * 7) % 40, 1.0) for k in range(1, 40)] + [(k, 0, 0.5) for k in range(1, 40)]
    graph = graph_from_tables(
        spark.createDataFrame([(k,) for k in range(40)], "id bigint"),
        spark.createDataFrame(edges, EDGE_SCHEMA),
    )
    plain = rows(pagerank(graph, fixed_iter=4))
    monkeypatch.setattr(walk, "ROWS_PER_SLOT", 5)
    cut = Store(spark)
    prepared = walk.prepare_walk(graph.vertices, graph.edges, cut, rows_per_slot=5)
    slots = prepared.links.filter("src = 0").select("slot").distinct().count()
    assert slots > 4
    spread = walk.iterate_walk(prepared, 0.85, 20.0, cut, fixed_iter=4)
    found = rows(spread.table.df.select("id", "p"))
    prepared.close()
    assert [i for i, _ in found] == [i for i, _ in plain]
    assert [p for _, p in found] == pytest.approx([p for _, p in plain], abs=1e-14)


def small_graph(spark, edges, count):
    return Graph(
        spark.createDataFrame([(i, str(i), i) for i in range(1, count + 1)], VERTEX_SCHEMA),
        spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], EDGE_SCHEMA),
    )


def test_initial_partition(spark):
    part = init_partition(small_graph(spark, [(1, 2, 1), (2, 1, 1), (1, 1, 1)], 2))
    assert rows(part.modules) == [(1, 1, 0.5, 0.5, 0.5), (2, 1, 0.5, 0.5, 0.5)]
    assert rows(part.links) == [(1, 2, 0.5), (2, 1, 0.5)]
    assert part.codelength == pytest.approx(3.0)

    part = init_partition(
        small_graph(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 1, 1), (4, 3, 1)], 4))
    p = [0.3704401385, 0.1949370588, 0.3971228027, 0.0375]
    assert [r[2] for r in rows(part.modules)] == pytest.approx(p, abs=1e-9)
    assert [r[2] for r in rows(part.links)] == pytest.approx(
        [p[0] / 2, p[0] / 2, p[1], p[2], p[3]], abs=1e-9)
    assert part.codelength == pytest.approx(3.6973058418, abs=1e-9)
    assert part.prob_sum == pytest.approx(sum(plogp_value(x) for x in p), abs=1e-8)

    # The predicted change of merging 2 and 3 is the change that follows.
    dl = {(r.src, r.dst): r.dl for r in merge.delta_table(part).collect()}
    moved = spark.createDataFrame([(3, 2)], "module bigint, target bigint")
    after = contract(part, moved)
    assert after.codelength == pytest.approx(part.codelength + dl[(2, 3)], abs=1e-12)
    assert codelength(after.modules, after.prob_sum) == pytest.approx(after.codelength)
    assert sum(r[2] for r in rows(after.modules)) == pytest.approx(1.0)


def test_zero_weights_and_zero_totals(spark):
    """A source whose weights are all 0 dangles; a 0 edge beside others stays a candidate."""
    part = init_partition(small_graph(spark, [(1, 2, 1), (2, 1, 1), (2, 3, 0), (3, 1, 0)], 3))
    flows = {r[0]: r[3] for r in rows(part.modules)}
    assert flows[3] == 0.0 and flows[1] > 0.0
    assert {(r[0], r[1]) for r in rows(part.links)} == {(1, 2), (2, 1), (2, 3)}
    assert all(math.isfinite(r.dl) for r in merge.delta_table(part).collect())


def test_ties_keep_all_targets(spark):
    delta = spark.createDataFrame(
        [(1, 2, -1.0), (1, 3, -1.0 + 1e-14), (1, 4, -0.5), (6, 1, -2.0)], "src bigint, dst bigint, dl double")
    least = merge.smallest_delta(delta)
    assert rows(merge.best_targets(delta, least)) == [(1, 2), (1, 3), (6, 1)]
    assert rows(merge.best_targets(delta, least, tie_tol=0.0)) == [(1, 2), (6, 1)]


@pytest.mark.parametrize("tie_tol", [0.0, merge.TIE_TOLERANCE])
def test_every_module_with_a_gain_proposes(net, tie_tol):
    graph = net("four-groups")
    folder = Store(graph.spark)
    part = init_partition(graph, store=folder)
    gains = {r.src for r in merge.symmetric_deltas(part).filter("dl < 0").collect()}
    assert {r.src for r in merge.choose_merges(part, "symmetric", folder, tie_tol).df.collect()} == gains


def files_of(folder):
    return {name.split("-", 1)[1] for name in os.listdir(folder.folder.removeprefix("file:"))}


def test_superseded_tables_are_dropped(net):
    graph = net("four-groups")
    folder = Store(graph.spark)
    connected_components(graph.edges, folder)
    assert files_of(folder) == {"labels"}
    folder = Store(graph.spark)
    found = multi_merge(graph, init_partition(graph, store=folder), store=folder)
    # The caller's first partition, the last state, and one map of both rounds for the vertex table.
    names = sorted(name.split("-", 1)[1] for name in os.listdir(folder.folder.removeprefix("file:")))
    assert names == ["composed-map", "contracted", "links", "modules", "modules"]
    assert found.part.codelength == pytest.approx(3.5140300102, abs=1e-9)
    assert found.graph.vertices.count() == 25


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    store = Store(spark)
    before = files()
    table = store.cut(spark.range(1000).repartition(4).groupBy("id").count(), "moved")
    bucketed = store.cut_in_buckets(spark.range(1000), "bucketed", 4, "id")
    assert files() <= before
    assert table.rows == 1000 and bucketed.df.count() == 1000
    assert spark.conf.get(FILE_CLEANUP, None) is None


def test_hubs_over_many_slots(net):
    graph = net("four-groups")
    plain, spread = (rows(pagerank(graph, rows_per_slot=n)) for n in (10 ** 6, 1))
    assert [p for _, p in spread] == pytest.approx([p for _, p in plain], abs=1e-12)


def test_checkpoint_folder_is_the_sessions(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        assert Store(spark).folder.startswith(folder.rstrip("/"))


MODULES = [(1, 3, 0.4, 0.1, 0.1), (2, 1, 0.3, 0.1, 0.1), (3, 2, 0.2, 0.1, 0.1), (4, 1, 0.1, 0.0, 0.0)]


def test_analysis(spark):
    modules = spark.createDataFrame(MODULES, "module bigint, n bigint, p double, w double, q double")
    links = spark.createDataFrame([(1, 2, 0.1), (2, 1, 0.1), (1, 3, 0.1)], EDGE_SCHEMA)
    stats = analysis.module_stats(modules, links).first().asDict()
    assert stats == pytest.approx({
        "modules": 4, "singletons": 2, "small": 2, "insignificant": 3, "significant": 1,
        "mean_nodes": 3.0, "mean_frequency": 0.4, "total_frequency": 0.4,
        "insignificant_per_significant": 3.0, "components": 2, "significant_per_component": 0.5,
    })
    assert rows(analysis.component_sizes(modules, links)) == [(1, 3), (4, 1)]
    assert rows(analysis.degrees(modules, links)) == [(1, 3), (2, 2), (3, 1), (4, 0)]
    significant = analysis.is_significant(analysis.expected_share(modules))
    kept, inside = analysis.induced_subgraph(modules, links, significant)
    assert [r[0] for r in rows(kept)] == [1] and rows(inside) == []
    kept, inside = analysis.induced_subgraph(modules, links, analysis.is_singleton())
    assert rows(analysis.degrees(kept, inside)) == [(2, 0), (4, 0)]


def test_histogram(spark):
    import numpy

    values = [0.0, 0.1, 0.25, 0.5, 0.5, 0.99, 1.0, 7.5, 10.0]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for above in (None, 0.3):
        counts, bounds = numpy.histogram([v for v in values if above is None or v > above])
        found = rows(analysis.histogram(table, "x", above=above), "bin")
        assert [r[3] for r in found] == list(counts)
        assert [r[1] for r in found] + [found[-1][2]] == pytest.approx(list(bounds))
    assert [r[3] for r in rows(analysis.histogram(table, "x", bins=2, above=9), "bin")] == [0, 1]
    assert rows(analysis.histogram(table, "x", above=99)) == []


def test_step_moves_no_links(spark, net, monkeypatch):
    """Even without broadcasts and caches a step neither shuffles, sorts nor recomputes the written links."""
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        graph, cut = net("four-groups"), Store(spark)
        prepared = walk.prepare_walk(graph.vertices, graph.edges, cut)
        spark.catalog.clearCache()
        step = walk.pagerank_step(prepared, walk.start_frequencies(prepared), 0.0, 0.85)
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
        final = plan[:plan.index("Initial Plan")]
        joined = final[final.index("ShuffledHashJoin"):final.index("Bucketed: true")]
        assert "Exchange" not in joined and "Sort [" not in joined
        prepared.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("fold_every", [1, 3, 100])
def test_candidate_index_equals_the_rewritten_table(spark, fold_every):
    """Appended rows give the same best pair and the same live table as rewriting all candidates per merge."""
    rng = random.Random(8)
    links = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(60)})
    graph = graph_from_tables(
        spark.createDataFrame([(i,) for i in range(24)], "id bigint"),
        spark.createDataFrame([(a, b, rng.random()) for a, b in links], "src bigint, dst bigint, weight double"))
    cut = Store(spark)
    part = init_partition(graph)
    index = pairs.CandidateIndex.start(part, cut, fold_every)
    table = spark.createDataFrame(pairs.candidate_table(part).toPandas())
    written = 0
    for _ in range(6):
        best = index.best
        assert best.asDict() == pytest.approx(pairs.best_merge(table).first().asDict())
        part = pairs.merged_scalars(part, best)
        table = spark.createDataFrame(pairs.update_candidates(table, part, best).toPandas())
        index.apply(part, best)
        written += index.n_added
        live = {(r.m1, r.m2): r.w1221 for r in index.live().collect()}
        assert live == pytest.approx({(r.m1, r.m2): r.w1221 for r in table.collect()})
    assert len(index.added) == {1: 0, 3: 0, 100: 6}[fold_every]
    if fold_every == 100:
        assert index.n_added < 3 * len(links)
    index.close()
    assert not cut.written_since(0)


@pytest.mark.parametrize("direction", ["symmetric", "asymmetric"])
def test_pairs_dealt_over_slots_give_the_same_merges(net, direction, monkeypatch):
    graph = net("four-groups")
    store = Store(graph.spark)
    part = init_partition(graph, store=store)
    written, cut = {}, Store.cut

    def counted(self, df, name, *args, **metrics):
        table = cut(self, df, name, *args, **metrics)
        written.setdefault(name, []).append(table.rows)
        return table
    monkeypatch.setattr(Store, "cut", counted)
    plain = merge.choose_merges(part, direction, store)
    dealt = merge.choose_merges(part, direction, store, rows_per_slot=1)
    assert written["busy-cells"] and rows(plain.df) == rows(dealt.df)
    assert rows(merge.scored_pairs(part, store, 1).select("m1", "m2", "forth", "back")) == rows(
        merge.scored_pairs(part, store).select("m1", "m2", "forth", "back"))
    # What cannot be the best of its source is not written.
    every = (merge.symmetric_deltas if direction == "symmetric" else merge.delta_table)(part).filter("dl < 0")
    assert written["proposals"][0] < every.count()
    least = merge.smallest_delta(every)
    assert rows(plain.df) == rows(merge.best_targets(every, least))


def test_prepared_links_move_once(net, monkeypatch):
    """Besides the few rows of the sources, only one exchange, into the buckets themselves."""
    graph, seen = net("four-groups"), []
    graph = Graph(graph.vertices, Store(graph.spark).cut(graph.edges, "edges").df)
    write = Store.cut_in_buckets
    monkeypatch.setattr(Store, "cut_in_buckets", lambda self, df, name, buckets, *by, placed=False: (
        seen.append(df if placed else df.repartition(buckets, *by)), write(self, df, name, buckets, *by, placed=placed))[1])
    graph.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    graph.spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        prepared = walk.prepare_walk(graph.vertices, graph.edges, Store(graph.spark))
        plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
        files = len(prepared.links.inputFiles())
        prepared.close()
    finally:
        graph.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        graph.spark.conf.set("spark.sql.shuffle.partitions", "8")
    # Two for the join with the (empty) table of busy sources, which this test keeps from being broadcast.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count(", 23), ENSURE") == 2
    assert files <= 8  # one for each bucket


def test_graphs_of_queries_hold_written_sums(spark):
    from workloads.queries import _graph

    store = Store(spark)
    links = spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0), (2, 1, 1.0)], EDGE_SCHEMA)
    graph = _graph(store, links)
    assert rows(graph.edges) == [(1, 2, 3.0), (2, 1, 1.0)]
    assert "Aggregate" not in graph.edges._jdf.queryExecution().executedPlan().toString()


def recorded(monkeypatch):
    """Name, row count and executed plan of every table written from now on."""
    seen, cut = [], Store.cut

    def keep(self, df, name, *args, **metrics):
        table = cut(self, df, name, *args, **metrics)
        seen.append((name, table.rows, df._jdf.queryExecution().executedPlan().toString()))
        return table
    monkeypatch.setattr(Store, "cut", keep)
    return seen


def test_last_rounds_of_components_exchange_nothing(spark, monkeypatch):
    """Rounds over few edges stay in single partitions; their labels are those of the other way."""
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 700)]
    links = Store(spark).cut(spark.createDataFrame(edges, "src bigint, dst bigint").repartition(3), "edges")
    spread = connected_components(links.df, n_edges=links.rows, rows_in_one_task=0)
    mixed = connected_components(links.df, n_edges=links.rows, rows_in_one_task=100)
    seen = recorded(monkeypatch)
    alone = connected_components(links.df, n_edges=links.rows)
    expected = sorted(smallest_ids(edges).items())
    assert rows(alone.df) == rows(mixed.df) == rows(spread.df) == expected
    assert len(seen) > 6 and not [name for name, _, plan in seen if "Exchange" in plan]


@pytest.mark.parametrize("direction", ["symmetric", "asymmetric"])
def test_only_proposals_near_the_best_are_written(net, direction, monkeypatch):
    """A source's proposals meet in one task, so those above its smallest are left out of the written table."""
    graph = net("four-groups")
    part = init_partition(graph, store=Store(graph.spark))
    seen = recorded(monkeypatch)
    merges = merge.choose_merges(part, direction, Store(graph.spark))
    written = {name: n for name, n, _ in seen}
    assert written["proposals"] == written["merges"] == merges.rows


def test_many_modules_are_hashed_not_sorted(net):
    graph = net("four-groups")
    store = Store(graph.spark)
    part = init_partition(graph, store=store)
    moved = merge.module_map(merge.choose_merges(part, "symmetric", store).df, store).df
    plain, hashed = contract_edges(part.links, moved), contract_edges(part.links, moved, HASHED_MODULES)
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan
    key = lambda df: [(a, b, round(w, 12)) for a, b, w in rows(df)]
    assert key(plain) == key(hashed)
